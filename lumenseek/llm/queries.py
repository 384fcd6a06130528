"""Queries op<N>_<name>: each operator with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, html_text, line_dedup, lm_score, mixing, simhash, substring_dedup, toxicity

#: Target weights of the sources; the others share what is left alike, each with weight 1.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}
#: Part of all tokens that the mixture holds.
SHARE = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file, from LLM_BPE_VOCAB or the installed package of public tokenizers."""
    if path := os.environ.get("LLM_BPE_VOCAB"):
        return path
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return "/opt/tokenizers/byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each duplicate line and the line kept for it."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "kept_doc_id", "kept_line_no")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that goes, with the one that stays for it."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every passage that repeats."""
    return substring_dedup.occurrences(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's expected severity and probabilities; is_toxic: P(severity > 0) is a half at least."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).withColumn("is_toxic", F.expr("p_toxic >= 0.5"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), WEIGHTS, share=SHARE).select("doc_id", "source", "tokens", "finish", "taken_tokens")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest, among all vectors, of each vector whose id is divisible by 20."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that goes, with the one that stays for it."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "kept_doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_exact_dedup, op4_lm_scoring, op5_html_extraction, op6_substring_dedup, op7_toxicity, op8_mixing, op9_ann, op10_simhash)}

_CASE = " ".join(f"WHEN '{s}' THEN CAST({w!r} AS DOUBLE)" for s, w in sorted(WEIGHTS.items()))
ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
SELECT doc_id, kept_doc_id FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS kept_doc_id, row_number() OVER w AS nth
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id)) WHERE nth > 1
""",
    "op8_mixing": f"""
WITH words AS (
  SELECT doc_id, source, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS squeezed, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counted AS (
  SELECT doc_id, source, h, CASE WHEN squeezed IS NULL OR squeezed = '' THEN 0 ELSE length(squeezed) - length(replace(squeezed, ' ', '')) + 1 END AS tokens FROM words),
timed AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) / (CASE source {_CASE} ELSE CAST(1.0 AS DOUBLE) END) AS finish FROM counted),
taken AS (
  SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, finish, CAST(sum(tokens) OVER (ORDER BY finish, source, h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS taken_tokens FROM timed)
SELECT * FROM taken WHERE taken_tokens <= (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * {SHARE}) AS BIGINT) FROM counted)
""",
}
