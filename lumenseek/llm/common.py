"""Shared plumbing: written intermediate tables, row keys, size-checked joins, Arrow buffers as numpy arrays."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs up to which the smaller side of a join is broadcast (about 50 MB in the hash relation).
BROADCAST_ROWS = 1_000_000


#: Bytes of one Arrow batch of texts, in the JVM and in a worker; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes: ten thousand rows, Spark's default, are as large as their texts. A lower bound that the
    session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to ask for
        return lambda _: 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving what the allocators keep back at the end of a task: workers outlive tasks and stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def lean_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """lean for functions of a group, or of two."""

    def one(a: pa.Table) -> pa.Table:
        try:
            return run(a)
        finally:
            _trim()(0)

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return run(a, b)
        finally:
            _trim()(0)

    return one if run.__code__.co_argcount == 1 else two


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


#: Paths of written tables, as long as their DataFrames are held.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; beyond that Spark shuffles both sides."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(docs: DataFrame) -> F.Column:
    """64 bits that identify a row by doc_id and text. Rows that have both alike are copies of one row."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def without_rows(docs: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose row_key is in dropped(rk), and with one of each set of repeated rows: the least, as JSON,
    where other columns differ."""
    rk, row = fresh(docs, "rk", "row")
    keyed = docs.withColumn(rk, row_key(docs))
    repeated = written(keyed.groupBy(rk).count().filter("count > 1").select(F.col(rk).alias("rk_r")))
    kept = keyed
    if dropped is not None:
        kept = kept.join(sized(dropped.select(F.col("rk").alias("rk_d"))), F.col(rk) == F.col("rk_d"), "left_anti")
    if (n := repeated.count()) == 0:
        return kept.drop(rk)
    hint = sized(repeated, n)
    once = kept.join(hint, F.col(rk) == F.col("rk_r"), "left_anti")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = kept.join(hint, F.col(rk) == F.col("rk_r"), "left_semi").groupBy(rk).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return once.drop(rk).unionByName(again.select(f"{row}.*"))


def parts(df: DataFrame, per: int, most: int = 1 << 20) -> int:
    """Parts to cut a key space in, each one task: as many as shuffles have, more where df has over `per` rows for each."""
    return min(most, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // per)))


# ---- Arrow columns as numpy


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def valid(column: pa.Array) -> np.ndarray:
    return ~np.asarray(column.is_null())


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def padded(data: np.ndarray, start: int, end: int) -> np.ndarray:
    out = np.zeros(end - start + 16, np.uint8)
    out[: end - start] = data[start:end]
    return out


def u64_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset, as a view."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
S29, S32, S33 = np.uint64(29), np.uint64(32), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> S33)
    x *= C3
    x ^= x >> S29
    x *= C2
    x ^= x >> S32
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of padded data."""
    view = u64_at(data)
    h = (lengths.astype(np.uint64) + np.uint64(seed + 1)) * C1
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - 8 * k
        part = h[live] ^ (view[starts[live] + 8 * k] & MASK[np.minimum(left, 8)])
        part *= C2
        part ^= part >> S29
        h[live] = part * C1
        live, k = live[left > 8], k + 1
    return mix(h)


#: ASCII letters fold to lower case; other ASCII that isn't a letter or digit separates words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters."""
    out = FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    up = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[up] += 0x20
    return out


def word_spans(data: np.ndarray, end: int, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't in apart, in data[:end], broken at bounds."""
    gap = np.ones(end + 2, bool)
    gap[1 : end + 1] = apart[data[:end]]
    first = np.zeros(end + 1, bool)
    first[bounds] = True
    inside = ~gap
    starts = np.flatnonzero(inside[1:] & (gap[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (gap[1:] | first))
    return starts, ends
