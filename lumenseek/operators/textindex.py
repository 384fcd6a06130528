"""A trigram index of chunks: which chunks may hold a text, read from postings before any text is.

A gram is three bytes of the lower-case UTF-8 text. Postings lie by gram in partitions and sorted inside them, so a query
reads the row groups of its own few grams. Chunks found are candidates; the text predicates decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.language import Content, Plan

#: Partitions of the postings by gram.
BUCKETS = 16
#: Texts of so many bytes are cut into grams at a time.
BLOCK = 1 << 20


def chunk_id(chunk_hash: Column | str = "chunk_hash") -> Column:
    """A short name of a chunk in postings; two chunks that share one are both candidates."""
    return F.xxhash64(chunk_hash)


def grams_of(text: str) -> list[int]:
    b = text.lower().encode()
    return sorted({b[i] | b[i + 1] << 8 | b[i + 2] << 16 for i in range(len(b) - 2)})


def required_grams(term: Content, sensitive: bool) -> list[int]:
    """Grams that a chunk with the term has in any case; none where that can't be told. A case-sensitive term's letters
    beyond ASCII may fold otherwise inside a text than alone, so only its ASCII parts count."""
    if term.regex:
        return []
    if not sensitive:
        return grams_of(term.text)
    parts = "".join(c if c.isascii() else "\0" for c in term.text).split("\0")
    return sorted({g for p in parts for g in grams_of(p)})


def postings(chunks: DataFrame) -> DataFrame:
    """(bucket, gram, chunk_id) of every chunk, each gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            texts = batch.column(1).to_pylist()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def sent() -> pa.RecordBatch:
                grams, own = (np.concatenate(c) for c in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(own)], ["gram", "chunk_id"])

            for i, text in zip(ids, texts, strict=True):
                b = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
                if len(b) > 2:
                    g = np.unique(b[:-2] | b[1:-1] << 8 | b[2:] << 16)
                    held.append((g, np.full(len(g), i, np.int64)))
                    size += len(g)
                if size > BLOCK // 8:
                    yield sent()
                    held.clear()
                    size = 0
            if held:
                yield sent()

    rows = chunks.select(chunk_id().alias("chunk_id"), F.lower("text_content").alias("text"))
    return rows.mapInArrow(run, "gram int, chunk_id long").select((F.col("gram") % BUCKETS).alias("bucket"), "gram", "chunk_id")


def write_postings(chunks: DataFrame, path: str) -> None:
    postings(chunks).repartition("bucket").sortWithinPartitions("gram", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def candidates(postings: DataFrame, plans: list[Plan]) -> DataFrame | None:
    """(chunk_id) of chunks that have all grams of the required terms of one of the plans; None if a plan needs none."""
    wanted = {tuple(sorted({g for t in p.required for g in required_grams(t, p.case_sensitive)})) for p in plans}
    if not wanted or () in wanted:
        return None
    every = sorted({g for w in wanted for g in w})
    rows = postings.filter(F.col("bucket").isin(*{g % BUCKETS for g in every}) & F.col("gram").isin(*every))
    held = rows.groupBy("chunk_id").agg(F.collect_set("gram").alias("grams"))  # a query's own grams at most
    test = F.lit(False)
    for w in sorted(wanted):
        test = test | (F.size(F.array_intersect("grams", F.array(*map(F.lit, w)))) == len(w))
    return held.filter(test).select("chunk_id")
