"""Distributed union-find over edges of longs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, written


#: Edges that a task holds (16 bytes each, several times that while it joins them).
MOST_EDGES = 4_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component, with the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, n = np.arange(len(nodes)), len(a)
    u, v = at[:n], at[n:]
    while True:
        pu, pv = parent[u], parent[v]
        differ = pu != pv
        if not differ.any():
            break
        u, v, pu, pv = u[differ], v[differ], pu[differ], pv[differ]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    rest = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[rest], nodes[parent[rest]]


def local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition cut to those a union-find needs; of more than MOST_EDGES of these several forests."""

    def sent(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, limit = 0, MOST_EDGES // 2
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += len(held[-1][0])
        if n > limit:
            a, b = forest(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [(a, b)], len(a)
            if n > MOST_EDGES:
                yield from sent(a, b)
                held, n = [], 0
            limit = max(MOST_EDGES // 2, 2 * n)  # so that each forest is of twice the edges at least
    if n:
        yield from sent(*forest(*map(np.concatenate, zip(*held, strict=True))))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each node of edges(a, b) that isn't the least of its component; root is the least.

    Union-find first inside each partition, then between partitions by alternating large-star and small-star steps
    till nothing changes. A node's least neighbour comes from a combining aggregate and reaches its edges by a join, which
    adaptive execution splits or broadcasts, so that a star of any size is no one task. No edges: no rows.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(lean(local_forests), "a long, b long"))
    mark = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        before, e = e, written(small)
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = now
