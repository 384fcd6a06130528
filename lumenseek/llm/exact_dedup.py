"""Exact dedup by a Golomb-coded fingerprint exchange.

Each scan partition (a sender) sorts its rows' fingerprints, codes the gaps with a Golomb-Rice code and sends one coded
list to each owner of a range of fingerprints. Owners decode, find fingerprints that more than one row has, and answer
each list with a bitmap of duplicates. Only rows that a bitmap marks (suspects) have their texts shuffled and compared
byte by byte. Fingerprints have the bits that keep false suspects near one row in 256; the comparison removes those.

Defined cases: a null text is never a duplicate; empty texts are equal; of equal texts the row of the least doc_id (null
first) stays, of equal doc_ids any one, as their rows are alike here; repeated rows are duplicates of each other; a very
long text is hashed and compared whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, sized, written

#: Rows of one sender's list; a larger partition sends several.
CHUNK = 1 << 20
#: Rows whose fingerprints one owner decodes.
OWNED_ROWS = 1 << 20


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Rising distinct numbers under span: byte 0 holds the remainder's bits, then unary quotients, then remainders."""
    n = len(values)
    k = max(0, int(span / max(n, 1) * 0.69).bit_length() - 1)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    k = code[0]
    rest_bytes = (n * k + 7) // 8
    body = np.frombuffer(code, np.uint8)[1:]
    unary = np.unpackbits(body[: len(body) - rest_bytes])
    stops = np.flatnonzero(unary)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(body[len(body) - rest_bytes :], count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def owned(table: pa.Table) -> pa.Table:
    """(sender, base, marks): for each list sent to one owner, the bitmap of values that come more than once in all."""
    sender, base, n, code = (table.column(c).to_pylist() for c in ("sender", "base", "n", "code"))
    lists = [golomb_decode(c, k) for c, k in zip(code, n, strict=True)]
    every = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pa.table({"sender": pa.array(sender, pa.string()), "base": pa.array(base, pa.int32()), "n": pa.array(n, pa.int32()), "marks": pa.array(marks, pa.binary())})


def suspects(docs: DataFrame) -> DataFrame:
    """(h) hashes of the texts that may come more than once."""
    spark = docs.sparkSession
    owners = parts(docs, OWNED_ROWS)
    bits = min(64, docs.count().bit_length() + 8)
    span = -(-(1 << bits) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def lists(h: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = f"{TaskContext.get().partitionId()}-{number}"
            number += 1
            f = h.view(np.uint64) >> np.uint64(64 - bits)
            order = np.argsort(f, kind="stable")
            h, f = h[order], f[order]
            new = np.concatenate([[True], f[1:] != f[:-1]])
            place = np.cumsum(new) - 1
            own = np.bincount(place)[place] > 1  # comes twice in this very list
            values = f[new]
            edges = np.searchsorted(values, np.arange(owners + 1, dtype=object).astype(np.float64) * span if bits > 62 else (np.arange(owners + 1) * span).astype(np.uint64))
            at = np.flatnonzero(np.diff(edges))
            m, k = len(h), len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (m + k)),
                    pa.array(np.concatenate([place.astype(np.int32), np.zeros(k, np.int32)])),
                    pa.array(np.concatenate([h, np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([own, np.zeros(k, bool)])),
                    pa.array(np.concatenate([np.full(m, -1, np.int32), at.astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(m, np.int32), edges[at].astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(m, np.int32), np.diff(edges)[at].astype(np.int32)])),
                    pa.array([None] * m + [golomb_encode(values[edges[p] : edges[p + 1]] - np.uint64(int(p) * span), span) for p in at], pa.binary()),
                ],
                ["sender", "place", "h", "own", "owner", "base", "n", "code"],
            )

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)))
            if sum(map(len, held)) >= CHUNK:
                yield from lists(np.concatenate(held))
                held = []
        if held:
            yield from lists(np.concatenate(held))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sender, base, n, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), count=n))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([sender] * len(at)), pa.array((at + base).astype(np.int32))], ["sender", "place"])

    hashed = docs.filter("text is not null").select(F.xxhash64("text").alias("h"))
    sent = written(hashed.mapInArrow(send, "sender string, place int, h long, own boolean, owner int, base int, n int, code binary"))
    answers = sent.filter("owner >= 0").select("owner", "sender", "base", "n", "code").groupBy("owner").applyInArrow(owned, "sender string, base int, n int, marks binary")
    places = written(answers.mapInArrow(marked, "sender string, place int"))
    rows = sent.filter("owner < 0")
    across = rows.join(sized(places), ["sender", "place"], "left_semi").select("h")
    return written(across.unionByName(rows.filter("own").select("h")).distinct())


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of each row that goes, with the row that stays for it.

    Suspects' texts are compared by a combining aggregate, so that a text that many rows have is no one task; the groups
    that it finds are then named by 128 bits, and only these and doc_ids move again."""
    rows = docs.select("doc_id", "text").filter("text is not null").withColumn("h", F.xxhash64("text"))
    some = rows.join(sized(suspects(docs)), "h", "left_semi")
    groups = some.groupBy("h", "text").agg(F.min(F.struct("doc_id")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups.select("h", F.xxhash64(F.lit(1), "text").alias("h2"), F.col("kept.doc_id").alias("kept_doc_id")))
    named = some.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2")).join(sized(groups), ["h", "h2"])
    named = written(named.select("doc_id", "h", "h2", "kept_doc_id"))
    first = F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))
    # of rows with the kept doc_id all but one go
    again = named.filter(first).groupBy("h", "h2", "doc_id", "kept_doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    again = again.select("doc_id", "kept_doc_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("col")
    return named.filter(~first).select("doc_id", "kept_doc_id").unionByName(again)
