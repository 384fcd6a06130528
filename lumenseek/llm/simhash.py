"""SimHash near-dedup by random bit sampling.

Each document's distinct case-folded words vote on a 256-bit SimHash. Several tables group documents by sampled bits;
oversized buckets are split by additional bits, by as many choices of them as find SPLIT_RECALL of the pairs MOST_APART bits
apart; distances of all pairs left in a bucket are verified, but for pairs that others have connected already. Near pairs
are joined by union-find and one document of each group stays, the first by (doc_id, row key).

No bucket is cut short. A pair d bits apart meets in a table with a chance of (1 - d/256)^SAMPLED: one of 56 bits, the
limit, is found with a chance of 0.88 (0.86 where buckets are split), of 45 bits 0.98, of 36 bits or fewer 0.995 and more;
groups hold together by any of their pairs.

Defined cases: a text that is null or has no word has no SimHash and is never a duplicate; texts of any length count all
their distinct words; rows with the same doc_id and text are one row; equal SimHashes are one until they are counted; an
empty table gives no rows; doc_id has any type that can be ordered; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import APART, C1, C2, blocks, bounded, folded, hash_spans, lean, lean_group, mix, padded, parts, row_key, sized, text_buffers, without_rows, word_spans, written
from .components import components, forest
from .line_dedup import shards, unpack

WORDS64 = 4
BITS = 64 * WORDS64
MOST_APART = 56  # bits of 256: a cosine of about 0.77 between the word sets
TABLES, SAMPLED = 24, 10
#: Buckets with more rows are split, and the part of the pairs at the limit that the ways to split find.
CAP, SPLIT_RECALL = 512, 0.95

#: Documents for each part of the bucket keys (some 50 MB in all tables).
PART_ROWS = 40_000

_rng = np.random.default_rng(77)
SAMPLES = np.array([_rng.permutation(BITS) for _ in range(TABLES)])
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def simhashes(data: np.ndarray, end: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their SimHashes, for rows of padded data."""
    raw = folded(data)
    starts, ends = word_spans(raw, end, offsets[:-1], APART)
    row = np.searchsorted(offsets, starts, "right") - 1
    # a row's distinct words: 24 bits of row number, 40 of hash
    h = np.unique((row.astype(np.uint64) << np.uint64(40)) | (hash_spans(raw, starts, ends - starts) >> np.uint64(24)))
    row = (h >> np.uint64(40)).astype(np.int64)
    h = h & np.uint64((1 << 40) - 1)
    votes = np.zeros((len(offsets) - 1, BITS), np.int32)
    count = np.bincount(row, minlength=len(offsets) - 1)
    edge = np.concatenate([[0], np.cumsum(count)])
    # counters of eight bits hold 255 words
    cuts = np.unique(np.concatenate([edge[:-1][count > 0], *(np.arange(edge[r], edge[r + 1], 255) for r in np.flatnonzero(count > 255))])).astype(np.int64)
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros((0, WORDS64), np.uint64)
    owner = row[cuts]
    for w in range(WORDS64):
        b = np.ascontiguousarray(mix((h + np.uint64(w + 1)) * C1)).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(SPREAD[b], cuts, axis=0)  # one counter a byte
        np.add.at(votes[:, 64 * w : 64 * w + 64], owner, sums.view(np.uint8).reshape(len(cuts), 64).astype(np.int32))
    has = np.flatnonzero(count)
    ones = 2 * votes[has] > count[has][:, None]
    return has, np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1, WORDS64)


def split_ways(more: int) -> int:
    """Choices of so many further bits by which a pair at the limit meets with a chance of SPLIT_RECALL."""
    return int(np.ceil(np.log(1 - SPLIT_RECALL) / np.log(1 - (1 - MOST_APART / BITS) ** more)))


def sampled(f: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The given bits of each SimHash as one number."""
    out = np.zeros(len(f), np.uint64)
    for k, b in enumerate(bits):
        out |= ((f[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) << np.uint64(k)
    return out


def near_pairs(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs in the runs of equal keys, whose SimHashes are near."""
    first, second = [], []
    at, d = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        for k in range(0, len(at), 1 << 18):
            i = at[k : k + (1 << 18)]
            apart = np.zeros(len(i), np.int32)
            for w in range(WORDS64):
                apart += np.bitwise_count(f[i, w] ^ f[i + d, w])
            near = i[apart <= MOST_APART]
            first.append(near)
            second.append(near + d)
        d += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def connecting(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near SimHashes that connect all that near pairs connect: those reached so far against those left, so
    that a group of copies takes about as many comparisons as it has members."""
    first, second = [np.zeros(0, int)], [np.zeros(0, int)]
    left = np.arange(len(f))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            own, front = np.split(front, [max(1, (1 << 18) // len(left))])
            apart = np.zeros((len(own), len(left)), np.uint16)
            for w in range(WORDS64):
                apart += np.bitwise_count(f[own, w][:, None] ^ f[left, w][None, :])
            near = apart <= MOST_APART
            hit = near.any(axis=0)
            if hit.any():
                first.append(own[near.argmax(axis=0)[hit]])
                second.append(left[hit])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    return np.concatenate(first), np.concatenate(second)


def bucket_pairs(table: pa.Table) -> pa.Table:
    """(a, b) of near documents of the buckets of one part; bucket words are [key, SimHash, id]."""
    t = unpack(table, WORDS64 + 2)
    t = t[np.argsort(t[:, 0], kind="stable")]
    key, f, ids = t[:, 0], np.ascontiguousarray(t[:, 1 : 1 + WORDS64]).view(np.uint64), t[:, -1]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(t) else np.zeros(0, int)
    size = np.diff(start, append=len(t))
    small = np.repeat(size <= CAP, size)
    pairs = []

    def take(which: np.ndarray, k: np.ndarray) -> None:
        """Pairs in the runs of equal k: all of short runs, what connects the others."""
        cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        long = np.diff(cut, append=len(k)) > CAP
        for s, e in zip(cut[long], np.append(cut[1:], len(k))[long], strict=True):
            u, v = connecting(f[which[s:e]])
            pairs.append((ids[which[s:e]][u], ids[which[s:e]][v]))
        rest = ~np.repeat(long, np.diff(cut, append=len(k)))
        u, v = near_pairs(k[rest], f[which[rest]])
        pairs.append((ids[which[rest]][u], ids[which[rest]][v]))
        if sum(len(u) for u, _ in pairs) > 1_000_000:
            pairs[:] = [forest(*map(np.concatenate, zip(*pairs, strict=True)))]

    if small.any():
        take(np.flatnonzero(small), key[small])
    for s, m in zip(start[size > CAP], size[size > CAP], strict=True):
        own = np.arange(s, s + m)
        more = int(np.ceil(np.log2(m / (CAP / 8))))
        ways = split_ways(more)
        rng = np.random.default_rng(int(key[s]) & 0xFFFFFFFF)
        for _ in range(ways):
            k = sampled(f[own], rng.permutation(BITS)[:more])
            order = np.argsort(k, kind="stable")
            take(own[order], k[order])
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(a):
        a, b = forest(a, b)
    return pa.table({"a": a, "b": b})


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, f0..f3) of rows that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in blocks(offsets, 1 << 20):
                lo, hi = int(offsets[i]), int(offsets[j])
                if hi > lo:
                    has, f = simhashes(padded(data, lo, hi), hi - lo, offsets[i : j + 1] - lo)
                    own = pa.array(has + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(f[:, w].view(np.int64)) for w in range(WORDS64))], ["doc_id", "rk", *(f"f{w}" for w in range(WORDS64))])

    bounded(docs.sparkSession)
    rows = docs.select("doc_id", "text").filter("text is not null").select("doc_id", row_key(docs).alias("rk"), "text")
    return rows.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, rk long, " + ", ".join(f"f{w} long" for w in range(WORDS64)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, kept_doc_id) of each row that goes; rows with the same doc_id and text are one row."""
    fs = [f"f{w}" for w in range(WORDS64)]
    table = written(signed(docs).withColumn("id", F.xxhash64(*fs)))
    n = parts(table, PART_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.column_stack([np.asarray(batch.column(w)) for w in range(WORDS64)]).view(np.uint64)
            ids = np.asarray(batch.column(WORDS64))
            keys = np.concatenate([mix((sampled(f, SAMPLES[t][:SAMPLED]) + np.uint64(t << 16) + np.uint64(1)) * C2) for t in range(TABLES)])
            many = np.tile(np.arange(len(ids)), TABLES)
            yield from shards(keys, [*(f[many, w] for w in range(WORDS64)), ids[many]], n)

    distinct = table.groupBy("id").agg(*(F.first(f).alias(f) for f in fs)).select(*fs, "id")
    edges = distinct.mapInArrow(lean(place), "part int, data binary").groupBy("part").applyInArrow(lean_group(bucket_pairs), "a long, b long")
    roots = written(components(edges))
    groups = written(table.select("doc_id", "rk", "id").join(sized(roots), "id", "left").select("doc_id", "rk", F.coalesce("root", "id").alias("root")))
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("root", "kept")
    return groups.join(kept, "root").filter("rk <> kept.rk").select("doc_id", "rk", F.col("kept.doc_id").alias("kept_doc_id")).distinct()


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies."""
    return without_rows(docs, written(near_duplicates(docs).select("rk")))
