"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest pivots in order. It is posted under each of them, with its place, in the
pivot's inverted file. A query reads the files of its own PREFIX pivots and adds up what they say of the footrule distance
between the two orders (a pivot outside a prefix counts as place PREFIX). Rows within CUT are candidates and are reranked
by exact cosine similarity. A query with fewer than `top` candidates is compared with all rows, so every query is answered.

Whether a row is a candidate depends on the two vectors and the pivots alone, not on the table's size or how it is cut.
Rows are cut in shards by their nearest pivot, large pivots in several shards, so that rows of one region lie together.
Blocks of queries, cut likewise, go only to shards that post one of their pivots: where the vectors form regions, to a few.
Vectors without structure have candidates in every shard; then work grows as queries times rows, as for any exact search.

Pivots are spread by farthest-first choice over a sample of `sample` rows (a bound for any table: an index may be fit on
one). Every row is indexed. On the check's tables, which are near random in 64 dimensions and so the hardest case, 0.42 of
the rows are candidates, and of the true ten nearest 0.96 to 0.99 are found in tables of 500 to 51,282 rows.

Defined cases: null vectors, vectors with a null, a NaN or an infinite value or of norm 0, and vectors of another length
than most have no neighbours and are nobody's; an id that is null likewise; ties of similarity go to the lesser vec_id;
rows that repeat a vec_id are one item, near another by their nearest vectors, that isn't its own neighbour and comes once
among those of others; tables of under top + 1 items give all there are; an empty table gives no rows; vec_id has any type
that can be ordered; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, lean_group, sized, written

PIVOTS, SAMPLE, PREFIX = 256, 4000, 24
#: Largest footrule distance of a candidate; two prefixes without a common pivot are PREFIX * (PREFIX + 1) = 600 apart.
CUT = 560
BLOCK_ROWS = 4096


def spread_pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """m of the unit vectors of a sample, each the one farthest from those before it."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(m, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def inverted_files(near: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and places posted under each pivot, one file after the other, and where each begins."""
    pivot = near.ravel()
    at = np.argsort(pivot, kind="stable")
    prefix = near.shape[1]
    return (at // prefix).astype(np.int32), (at % prefix).astype(np.int32), np.searchsorted(pivot[at], np.arange(m + 1))


def within(q_near: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, cut: int) -> np.ndarray:
    """Rows at a footrule distance of at most cut. A pivot at places a and b of the two prefixes takes
    2 min(prefix - a, prefix - b) off the distance of prefixes without a common pivot."""
    rows, places, edge = files
    prefix = len(q_near)
    spans = [slice(edge[p], edge[p + 1]) for p in q_near]
    own = np.repeat(np.arange(prefix), [s.stop - s.start for s in spans])
    place = np.concatenate([places[s] for s in spans])
    saved = np.bincount(np.concatenate([rows[s] for s in spans]), weights=prefix - np.maximum(place, own), minlength=n)
    return np.flatnonzero(prefix * (prefix + 1) - 2 * saved <= cut)


def best_of(x: np.ndarray, ids: np.ndarray, near: np.ndarray, q: np.ndarray, own: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The top ids of the given rows by similarity with q, other than its own; of rows with one id the nearest."""
    near = near[ids[near] != own]
    sims = x[near] @ q
    if len(sims) > 16 * top:  # ids repeat seldom; where they leave too few, all are sorted
        low = np.partition(sims, len(sims) - 4 * top)[len(sims) - 4 * top]
        some = np.flatnonzero(sims >= low)
        if len(np.unique(ids[near[some]])) >= top:
            near, sims = near[some], sims[some]
    order = np.lexsort((ids[near], -sims))
    found, sims = ids[near[order]], sims[order]
    first = np.sort(np.unique(found, return_index=True)[1])[:top]
    return found[first], sims[first]


def neighbours(vectors: DataFrame, top: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, cut: int = CUT, sample: int = SAMPLE, queries: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): the top nearest of each queried vector, rank from 1. queries: a condition
    on the columns of vectors; all rows if there is none. Every row is searched."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    names = ["vec_id", "neighbour_id", "rank", "similarity"]
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), asked.alias("asked"))
    rows = rows.filter("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = cast('Infinity' as float))").filter("aggregate(embedding, 0D, (a, x) -> a + x * x) > 0")
    width = F.size("embedding")
    most = rows.groupBy(width.alias("w")).count().orderBy(F.desc("count"), "w").first()
    if most is None:
        return spark.createDataFrame([], f"vec_id {kind}, neighbour_id {kind}, rank int, similarity double")
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    # other ids are numbered by their order, in which ties go; the numbers are exchanged for the ids at the end
    usable = rows.filter(width == most["w"]).groupBy("vec_id", "embedding").agg(F.max("asked").alias("asked"))
    names_of = None
    if not whole:
        names_of = written(_numbered(usable.select(F.col("vec_id").alias("named")).distinct()))
        usable = usable.join(names_of, F.col("vec_id") == F.col("named")).drop("vec_id", "named").withColumnRenamed("number", "vec_id")
    usable = written(usable.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "asked"))
    some = usable.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).collect()  # so many whatever the table
    x = np.array([r.embedding for r in some], np.float32)
    shared = spark.sparkContext.broadcast(spread_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), pivots))
    m = len(shared.value)
    dim = int(most["w"])
    prefix, reach = min(prefix, m), cut if prefix <= m else m * (m + 1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("embedding").flatten(), np.float32).reshape(len(b), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = orders(x, shared.value, prefix)
            packed = [pa.array([row.tobytes() for row in c], pa.binary()) for c in (x, near)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asked"), pa.array(near[:, 0].astype(np.int32)), *packed], ["vec_id", "asked", "pivot", "x", "near"])

    indexed = written(usable.mapInArrow(lean(nearest), "vec_id long, asked boolean, pivot int, x binary, near binary"))

    def pack(t: pa.Table) -> pa.Table:
        """A block as one row: its vectors in the order of ids, their prefixes, and the pivots that post any."""
        order = np.argsort(np.asarray(t.column("vec_id")), kind="stable")
        data = [b"".join(t.column(c).take(pa.array(order)).to_pylist()) for c in ("x", "near")]
        posted = np.unique(np.frombuffer(data[1], np.int16)).astype(np.int32)
        return pa.table({"block": t.column("block").slice(0, 1), "ids": pa.array([np.asarray(t.column("vec_id"))[order].tobytes()], pa.binary()), "x": pa.array([data[0]], pa.binary()), "near": pa.array([data[1]], pa.binary()), "posted": pa.array([posted], pa.list_(pa.int32()))})

    def blocks(rows: DataFrame) -> DataFrame:
        """Blocks of about BLOCK_ROWS rows: runs of small pivots in their order, parts of large ones."""
        starts: list[tuple[int, int, int]] = []
        n = room = 0
        for pivot, count in sorted(rows.groupBy("pivot").count().collect()):  # a row for each pivot
            if count > BLOCK_ROWS or count > room:
                parts = -(-count // BLOCK_ROWS)
                starts.append((pivot, n, parts))
                n += parts
                room = 0 if parts > 1 else BLOCK_ROWS - count
            else:
                starts.append((pivot, n - 1, 1))
                room -= count
        first = spark.createDataFrame(starts, "pivot int, first int, parts int")
        placed = rows.join(F.broadcast(first), "pivot").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(9)), "parts")).cast("int"))
        return written(placed.select("block", "vec_id", "x", "near").groupBy("block").applyInArrow(lean_group(pack), "block int, ids binary, x binary, near binary, posted array<int>"))

    index = blocks(indexed)
    asking = index if queries is None else blocks(indexed.filter("asked"))

    def searched(pairs: DataFrame, q: DataFrame, limit: int | None) -> DataFrame:
        """The best of each pair (q_block, s_block), and of them the top of each query."""

        def search(own: pa.Table, other: pa.Table) -> pa.Table:
            (q_ids, q, q_near), (s_ids, s, s_near) = (
                (np.frombuffer(t.column("ids")[0].as_py(), np.int64), *(np.frombuffer(t.column(c)[0].as_py(), kind).reshape(-1, size) for c, kind, size in (("x", np.float32, dim), ("near", np.int16, prefix)))) for t in (own, other)
            )
            files = inverted_files(s_near, m)
            every = np.arange(len(s_ids))
            out: list[tuple[np.ndarray, ...]] = [(q_ids[:0], q_ids[:0], q[:0, 0])]
            for i in range(len(q_ids)):
                near = every if limit is None else within(q_near[i], files, len(s_ids), limit)
                ids, sims = best_of(s, s_ids, near, q[i], q_ids[i], top)
                out.append((np.full(len(ids), q_ids[i]), ids, sims))
            a, b, c = map(np.concatenate, zip(*out, strict=True))
            return pa.table({"vec_id": a, "neighbour_id": b, "similarity": c.astype(np.float64)})

        def side(blocks: DataFrame, of: str) -> GroupedData:
            own = pairs.select(F.col("q_block").alias("u"), F.col("s_block").alias("v"))
            return own.join(blocks.select(F.col("block").alias(of), *(F.col(c).alias(c) for c in ("ids", "x", "near"))), of).select("u", "v", "ids", "x", "near").groupBy("u", "v")

        left, right = side(q, "u"), side(index, "v")
        best = left.cogroup(right).applyInArrow(lean_group(search), "vec_id long, neighbour_id long, similarity double")
        best = best.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
        w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
        return written(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*names))

    posted = lambda df, name: df.select(F.col("block").alias(name), F.explode("posted").alias("pivot"))
    pairs = written(posted(asking, "q_block").join(posted(index, "s_block"), "pivot").select("q_block", "s_block").distinct())
    found = searched(pairs, asking, reach)
    answered = found.groupBy("vec_id").count().filter(F.col("count") >= top).select("vec_id")
    short = written(indexed.filter("asked").join(sized(answered), "vec_id", "left_anti"))
    if not short.isEmpty():
        rest = blocks(short)
        n = index.agg(F.max("block")).first()[0]
        all_pairs = rest.select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("s_block"))
        exact = searched(all_pairs, rest, None)
        ids = short.select("vec_id").distinct()
        found = found.join(sized(ids), "vec_id", "left_anti").unionByName(exact)
    if names_of is None:
        return found.select(F.col("vec_id").cast(kind).alias("vec_id"), F.col("neighbour_id").cast(kind).alias("neighbour_id"), "rank", "similarity")
    for c in ("vec_id", "neighbour_id"):
        found = found.join(names_of, F.col(c) == F.col("number")).drop(c, "number").withColumnRenamed("named", c)
    return found.select(*names)


def _numbered(ids: DataFrame) -> DataFrame:
    """(named, number): ids and their places in their order. Ranges of ids get running totals, so no task orders all."""
    ranged = written(ids.repartitionByRange("named").withColumn("part", F.spark_partition_id()))
    ahead = ranged.groupBy("part").count().withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return ranged.join(F.broadcast(ahead), "part").select("named", (F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("named"))).alias("number"))
