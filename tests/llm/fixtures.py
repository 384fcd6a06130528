from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


def doc(i: int | None, text: str | None, source: str | None = "s") -> tuple:
    return (i, text, "en", source, None if text is None else len(text))


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCS)


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = words(rng, 30_000)
    same = words(rng, 80)
    return [doc(1, None), doc(2, ""), (None, words(rng, 60), None, None, None), doc(4, long), doc(5, "x" * 200_000), doc(6, same), doc(6, same), (None, None, None, None, None), doc(7, " \n\t\n ")]


def clash(df):
    """Extra columns named like those that operators use inside."""
    for c in ("rk", "h", "id", "root", "line", "line_no", "gone", "nth", "severity", "p_toxic", "expected_severity", "tokens", "finish", "last_source", "h_", "key", "part", "data", "kept", "range", "token_ids", "n_tokens"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df
