"""LM scoring by context-tree weighting.

A byte is eight binary decisions; each decision node (bits so far) has a context tree over the DEPTH bytes before. Every
tree node holds the Krichevsky-Trofimov estimate of its zeros and ones; the weighted probability of a node is half its own
estimate plus half the product of its children's. Counts come from all documents: grams of DEPTH bytes and the next one
are counted in each scan partition, sent to the owner of their last two context bytes, and summed. Owners mix depths 2 to
DEPTH of their subtrees; depths 0 and 1 (at most 256 contexts of 255 nodes, whatever the corpus) are mixed in one task.
The result is a code length for every gram of the corpus; a document's score is their mean, in bits per byte.

Defined cases: the context before a text is zero bytes; a null or empty text has 0 bytes and a null score; repeated rows
count each; a very long text is read whole, in rows of its own; an empty table gives no rows; doc_id has any type; other
columns don't matter. Grams of DEPTH + 1 bytes saturate slowly: 343,279 distinct ones in 2.5 MB of text, 752,921 in 25 MB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C1, MASK, S32, blocks, bounded, lean, lean_group, mix, parts, shared_dir, text_buffers, u64_at, written

DEPTH = 5
TOP = 2  # contexts of so many bytes own a subtree
#: Grams of the model that a scan task holds at a time (12 bytes each, twice that as a hash table).
SHARD_GRAMS = 4_000_000
#: Documents for each part of the model; it has 4096 parts at most.
PART_ROWS = 50_000
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte of rows i to j (context bytes low to high, then the byte), and the rows' offsets."""
    lo, hi = int(offsets[i]), int(offsets[j])
    rows = offsets[i : j + 1] - lo
    n = j - i
    buf = np.zeros(hi - lo + DEPTH * n + 16, np.uint8)
    if n == 1:
        buf[DEPTH : DEPTH + hi - lo] = data[lo:hi]
        at = slice(0, hi - lo)
    else:
        at = np.arange(hi - lo) + DEPTH * np.repeat(np.arange(n), np.diff(rows))
        buf[at + DEPTH] = data[lo:hi]
    return u64_at(buf)[at] & MASK[DEPTH + 1], rows


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return x[first], np.diff(first, append=len(x))


_LG = np.array([0.0] + list(np.cumsum(np.log(np.arange(0.5, 2000)))))  # log of prod (k + 1/2), by how many
_LF = np.array([0.0] + list(np.cumsum(np.log(np.arange(1.0, 4001)))))  # log of factorials


def _log_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2) / Gamma(1/2))."""
    x = np.maximum(n, 1) + 0.5
    big = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n < len(_LG), _LG[np.minimum(n, len(_LG) - 1)], big)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1) + 1.0
    big = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_LF), _LF[np.minimum(n, len(_LF) - 1)], big)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_half(n0) + _log_half(n1) - _log_factorial(n0 + n1)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | node) and bit of the eight decisions of each gram, gram by gram."""
    context = keys & MASK[DEPTH]
    byte = (keys >> _U(8 * DEPTH))[:, None]
    j = np.arange(8, dtype=np.uint64)
    node = (_U(1) << j) | (byte >> (_U(8) - j))
    return ((context[:, None] << _U(8)) | node).ravel(), ((byte >> (_U(7) - j)) & _U(1)).ravel().astype(np.int64)


def parent(nodes: np.ndarray) -> np.ndarray:
    """The node of a context shorter by its farthest byte."""
    return ((nodes >> _U(16)) << _U(8)) | (nodes & _U(255))


class Level:
    def __init__(self, nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, log_children: np.ndarray | None) -> None:
        self.nodes, self.n0, self.n1 = nodes, n0, n1
        own = log_kt(n0, n1)
        self.estimate = (n1 + 0.5) / (n0 + n1 + 1)
        self.log_w = own if log_children is None else np.log(0.5) + np.logaddexp(own, log_children)
        self.weight = np.ones(len(nodes)) if log_children is None else np.exp(np.log(0.5) + own - self.log_w)

    def up(self) -> tuple[Level, np.ndarray]:
        nodes, at = np.unique(parent(self.nodes), return_inverse=True)
        add = lambda v: np.bincount(at, weights=v, minlength=len(nodes))
        return Level(nodes, add(self.n0).round().astype(np.int64), add(self.n1).round().astype(np.int64), add(self.log_w)), at


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
    """The level of TOP-byte contexts; for each decision of each gram its node there, and the mixture of the levels below."""
    nodes, bit = decisions(keys)
    each = np.repeat(counts, 8)
    unique, at = np.unique(nodes, return_inverse=True)
    level = Level(unique, *(np.bincount(at, weights=np.where(bit == b, each, 0), minlength=len(unique)).round().astype(np.int64) for b in (0, 1)), None)
    path = np.arange(len(unique))
    mixed = level.estimate
    for _ in range(DEPTH - TOP):
        level, up = level.up()
        path = up[path]
        mixed = level.weight[path] * level.estimate[path] + (1 - level.weight[path]) * mixed
    return level, path[at], mixed[at], bit


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(b"".join(table.column("data").to_pylist()), np.int64).reshape(-1, 2)
    return summed(t[:, 0].view(np.uint64), t[:, 1])


def owner_of(keys: np.ndarray, n: int) -> np.ndarray:
    context = (keys >> _U(8 * (DEPTH - TOP))) & MASK[TOP]
    return ((mix((context + _U(1)) * C1) >> S32) % _U(n)).astype(np.int64)


def count_grams(docs: DataFrame, n: int) -> DataFrame:
    """(part, data): packed [gram, count] of all documents, by owner."""

    def sent(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = owner_of(keys, n)
        order = np.argsort(part, kind="stable")
        rows = np.column_stack([keys.view(np.int64), counts])[order]
        edges = np.searchsorted(part[order], np.arange(n + 1))
        filled = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([rows[edges[p] : edges[p + 1]].tobytes() for p in filled], pa.binary())], ["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in blocks(offsets, 4 << 20):
                held.append(counted(grams(data, offsets, i, j)[0]))
                if sum(len(k) for k, _ in held[1:]) > 2_000_000:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > 4_000_000:
                        yield from sent(*held.pop())
        if held:
            yield from sent(*summed(*map(np.concatenate, zip(*held, strict=True))))

    def add(table: pa.Table) -> pa.Table:
        keys, counts = _packed(table)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "data": pa.array([np.column_stack([keys.view(np.int64), counts]).tobytes()], pa.binary()), "grams": pa.array([len(keys)], pa.int64())})

    return docs.select("text").filter("text is not null").mapInArrow(lean(run), "part int, data binary").groupBy("part").applyInArrow(lean_group(add), "part int, data binary, grams long")


def model(docs: DataFrame) -> DataFrame:
    """(part, data, grams): packed [gram, code length in bits] for every gram of the documents."""
    n = parts(docs, PART_ROWS, 4096)
    table = written(count_grams(docs, n))

    def tops(t: pa.Table) -> pa.Table:
        level, *_ = subtrees(*_packed(t))
        return pa.table({"part": np.full(len(level.nodes), t.column("part")[0].as_py(), np.int32), "node": level.nodes.view(np.int64), "n0": level.n0, "n1": level.n1, "log_w": level.log_w})

    def heads(t: pa.Table) -> pa.Table:
        """What depths 0 to TOP - 1 say of each TOP-byte node: their share of the mixture, and the mass left below."""
        node = np.asarray(t.column("node")).view(np.uint64)
        level = Level.__new__(Level)
        level.nodes, level.n0, level.n1, level.log_w = node, *(np.asarray(t.column(c)) for c in ("n0", "n1", "log_w"))
        path, up = np.arange(len(node)), []
        for _ in range(TOP):
            level, at = level.up()
            path = at[path]
            up.append((level.weight[path], level.estimate[path]))
        said, left = np.zeros(len(node)), np.ones(len(node))
        for weight, estimate in reversed(up):
            said += left * weight * estimate
            left *= 1 - weight
        return pa.table({"part": t.column("part"), "node": t.column("node"), "said": said, "left": left})

    def finish(t: pa.Table, head: pa.Table) -> pa.Table:
        keys, counts = _packed(t)
        if not len(keys):
            return pa.table({"part": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "grams": pa.array([], pa.int64())})
        level, top, mixed, bit = subtrees(keys, counts)
        node = np.asarray(head.column("node")).view(np.uint64)
        order = np.argsort(node)
        at = order[np.searchsorted(node[order], level.nodes)]
        said, left = (np.asarray(head.column(c))[at][top] for c in ("said", "left"))
        p = said + left * mixed
        bits = -np.log2(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "data": pa.array([np.column_stack([keys.view(np.int64), bits.view(np.int64)]).tobytes()], pa.binary()), "grams": pa.array([len(keys)], pa.int64())})

    top = table.groupBy("part").applyInArrow(lean_group(tops), "part int, node long, n0 long, n1 long, log_w double").withColumn("one", F.lit(0))
    head = top.groupBy("one").applyInArrow(heads, "part int, node long, said double, left double")
    return written(table.groupBy("part").cogroup(written(head).groupBy("part")).applyInArrow(lean_group(finish), "part int, data binary, grams long"))


class Lookup:
    """Open-addressing hash table from grams to code lengths."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(2.5 * len(keys) + 1).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _U(2**64 - 1)), np.zeros(1 << bits, np.float32)
        slot, rest = self.slot(keys), np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == _U(2**64 - 1)
            self.keys[s[free]] = keys[rest[free]]
            done = self.keys[s] == keys[rest]
            self.values[s[done]] = values[rest[done]]
            rest = rest[~done]
            slot[rest] = (slot[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * C1) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, 0 for those that aren't there."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        rest = np.flatnonzero(found != keys)
        out[rest] = 0
        at = slot[rest]
        wanted = keys[rest]
        rest_found = found[rest]
        while len(rest):
            on = rest_found != _U(2**64 - 1)
            rest, at, wanted = rest[on], (at[on] + 1) & self.mask, wanted[on]
            rest_found = self.keys[at]
            hit = rest_found == wanted
            out[rest[hit]] = self.values[at[hit]]
            rest, at, wanted, rest_found = rest[~hit], at[~hit], wanted[~hit], rest_found[~hit]
        return out


def stored(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and code lengths of a shard, read from the shared folder."""
    if folder.startswith("file:"):
        system, root = fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    else:
        system, root = fs.FileSystem.from_uri(folder)
    files = fs.FileSelector(f"{root}/shard={shard}")
    t = [np.frombuffer(blob, np.int64).reshape(-1, 2) for f in sorted(i.path for i in system.get_file_info(files) if i.path.endswith(".parquet")) for blob in pq.read_table(f, columns=["data"], filesystem=system, partitioning=None).column("data").to_pylist()]
    return np.concatenate([x[:, 0].view(np.uint64) for x in t]), np.concatenate([x[:, 1].view(np.float64).astype(np.float32) for x in t])


def score(docs: DataFrame, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte).

    The model is streamed past the documents in shards: tasks read theirs from the shared folder, one scan of the documents
    for each shard, and neither the model nor a text passes the driver or a shuffle. A shard holds about shard_grams grams,
    or one part of the model where that is larger; a part holds whole TOP-byte contexts."""
    spark = docs.sparkSession
    bounded(spark)
    table = model(docs)
    sizes = table.select("part", "grams").orderBy("part").collect()
    shards: list[list[int]] = []
    room = 0
    for part, n in sizes:
        if not shards or n > room:
            shards.append([])
            room = shard_grams
        shards[-1].append(part)
        room -= n
    rows = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    if not shards:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0.0).alias("bits"), F.lit(None).cast("double").alias("bits_per_byte"))

    place = spark.createDataFrame([(p, k) for k, own in enumerate(shards) for p in own], "part int, shard int")
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    table.join(F.broadcast(place), "part").select("shard", "data").write.partitionBy("shard").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def scan(shard: int, ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = None
            for batch in batches:
                lookup = lookup or Lookup(*stored(where, shard))
                data, offsets = text_buffers(batch.column("text"))
                bits = np.zeros(len(batch))
                for i, j in blocks(offsets, 1 << 20):
                    g, edges = grams(data, offsets, i, j)
                    total = np.concatenate([[0], np.cumsum(lookup.get(g), dtype=np.float64)])
                    bits[i:j] = total[edges[1:]] - total[edges[:-1]]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "text"), pa.array(np.diff(offsets)), pa.array(bits)], [*(k for k in batch.schema.names if k != "text"), "n_bytes", "bits"])

        keys = ", ".join(f"{k} {t}" for k, t in ids.dtypes if k != "text")
        return ids.mapInArrow(lean(run), f"{keys}, n_bytes long, bits double")

    if len(shards) == 1:
        out = scan(0, rows)
    else:  # a row's parts are added up; repeated rows share a key, so their sum is shared among them
        keyed = rows.withColumn("rk", F.xxhash64("doc_id", "text"))
        every = scan(0, keyed)
        for k in range(1, len(shards)):
            every = every.unionByName(scan(k, keyed))
        of_key = every.groupBy("rk").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("bits").alias("bits"), F.count("*").alias("k"))
        n = F.expr(f"cast(k / {len(shards)} as int)")
        out = of_key.select("doc_id", "n_bytes", (F.col("bits") / n).alias("bits"), F.explode(F.sequence(F.lit(1), n)).alias("copy")).drop("copy")
    return out.select("doc_id", "n_bytes", "bits", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
