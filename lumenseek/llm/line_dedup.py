"""Line dedup: fuzzy lines by MinHash.

Character-shingle signatures, high-recall banding, exact Jaccard verification of candidates, distributed union-find, one
line kept per component: the first by (doc_id, line_no).

Defined cases: a null text has no lines; blank lines (of ASCII white space only, so the "\r" of an empty CRLF line) are
never duplicates; lines under SHINGLE characters match only identical lines; a very long line is signed and compared whole;
rows with the same doc_id and text are one row, and of those that differ in other columns the least as JSON stays; null
doc_ids order first; an empty table gives no rows; doc_id has any type that can be ordered. Other columns don't matter.

Lines are identical if 128 bits of hashes are: of 10**12 lines some tens of thousands of pairs share 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import characters
from .common import C1, S32, blocks, bounded, discard, fresh, lean, lean_group, mix, padded, parts, row_key, sized, text_buffers, without_rows, written
from .components import components

SHINGLE = 5
THRESHOLD = 0.6
BANDS, ROWS = 16, 4
#: Longer lines are banded by longer shingles: unrelated ones share too many short ones.
LONG_SHINGLE = 7
#: Lines of so many shingles are banded as long, and of fewer distinct ones than FEW as short, many lines as both. As
#: LONG <= THRESHOLD * FEW, each pair that reaches THRESHOLD has a kind in common.
LONG, FEW = 60, 100
#: Bits of the sketch by which pairs that can't reach THRESHOLD are refused before their texts are moved.
SKETCH = 2048
#: Lines of a bucket that are compared with as many others in one task, and pairs at a time.
BUCKET_BLOCK, PAIRS = 4096, 1 << 15
CODE_BITS = 9
#: Documents whose lines are in one part of the band keys.
PART_ROWS = 10_000

_rng = np.random.default_rng(20240607)
MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
BAND_SEED = _rng.integers(0, 1 << 63, BANDS, np.uint64) | np.uint64(1)


def mixed_characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the characters of the rows in padded data, and the rows' offsets among them."""
    n = int(offsets[-1])
    head = (data[:n] & 0xC0) != 0x80
    head[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(head)
    width = np.minimum(np.diff(at, append=n), 4)
    quad = np.ndarray((n + 4,), "<u4", buffer=data, strides=(1,))
    c = quad[at] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[width]
    c *= np.uint32(0x9E3779B1)
    c ^= c >> np.uint32(15)
    c *= np.uint32(0x85EBCA77)
    return c, np.searchsorted(at, offsets)


def shingles_of(c: np.ndarray, rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the w-character shingles of rows of mixed characters, and the rows' offsets among them."""
    h, span = c, 1
    while 2 * span <= w:
        h = h[: len(h) - span] * np.uint32(0x27D4EB2F) + h[span:] if len(h) > span else h[:0]
        span *= 2
    if span < w:
        h = h[: len(h) - (w - span)] * np.uint32(0x165667B1) + h[w - span :] if len(h) > w - span else h[:0]
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    count = np.maximum(np.diff(rows) - w + 1, 0)
    if (gaps := np.flatnonzero(np.diff(rows) > 0)).size:  # shingles that reach into the next row go
        keep = np.ones(len(c), bool)
        for k in range(1, w):
            keep[np.maximum(rows[1:][gaps] - k, rows[:-1][gaps])] = False
        h = h[keep[: len(h)]]
    return h, np.concatenate([[0], np.cumsum(count)])


def shingles(data: np.ndarray, offsets: np.ndarray, w: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """shingles_of the rows in padded data."""
    return shingles_of(*mixed_characters(data, offsets), w)


def of_rows(h: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the wanted rows only, and their offsets."""
    count = np.diff(rows)
    return h[np.repeat(wanted, count)], np.concatenate([[0], np.cumsum(count[wanted])])


def kinds_of(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of shingles are banded as short, and whether as long. Residues are at most as many as shingles."""
    count = np.diff(rows)
    seen = np.zeros(len(count) * 256, bool)
    seen[np.repeat(np.arange(len(count)) * 256, count) + (h & np.uint32(255))] = True
    return (count > 0) & (seen.reshape(-1, 256).sum(axis=1) < FEW), count >= LONG


def signatures(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash signatures of rows, each of one shingle at least. They lie hash by hash, as band_keys() reads them."""
    out = np.empty((BANDS * ROWS, len(rows) - 1), np.uint32)
    v = np.empty_like(h)
    for k in range(BANDS * ROWS):
        np.multiply(h, MULTIPLY[k], out=v)
        np.add(v, ADD[k], out=v)
        np.minimum.reduceat(v, rows[:-1], out=out[k])
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.T.reshape(BANDS, ROWS, len(sig))
    k = np.repeat(BAND_SEED[:, None], len(sig), axis=1)
    for r in range(ROWS):
        k = mix((k ^ s[:, r]) * C1)
    return k.T


def shards(keys: np.ndarray, columns: list[np.ndarray], n: int, salt: np.ndarray | None = None, ways: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (part, data): what belongs to each part of a key space, packed as 64-bit words, one column after the other. The
    rows of one key are in one part, or in `ways` parts by the salt."""
    part = (keys >> S32) % np.uint64(max(1, n // ways))
    if ways > 1:
        part = part * np.uint64(ways) + salt.view(np.uint64) % np.uint64(ways)
        n = max(1, n // ways) * ways
    order = np.argsort(part, kind="stable")
    table = np.column_stack([c.view(np.int64) for c in (keys, *columns)])[order]
    edges = np.searchsorted(part[order], np.arange(n + 1, dtype=np.uint64))
    filled = np.flatnonzero(np.diff(edges))
    yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([table[edges[p] : edges[p + 1]].tobytes() for p in filled], pa.binary())], ["part", "data"])


def unpack(table: pa.Table, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("data").to_pylist()), np.int64).reshape(-1, columns)


def blank(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r")) == ""


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, line_no, line, id, id2) of every line that isn't blank; a row may come more than once."""
    rows = docs.select("doc_id", "text").filter("text is not null").select("doc_id", row_key(docs).alias("rk"), "text")
    lines = rows.select("doc_id", "rk", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter(~blank(F.col("line"))).withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))


def buckets(table: pa.Table) -> pa.Table:
    """(bucket, a, b) of buckets of two lines or more; a is the least id of the bucket, b each id."""
    t = unpack(table, 2)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    if len(t):
        t = t[np.concatenate([[True], (t[1:] != t[:-1]).any(axis=1)])]
    new = np.concatenate([[True], t[1:, 0] != t[:-1, 0]]) if len(t) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(t))
    many = np.repeat(size > 1, size)
    first = np.repeat(t[start, 1], size)
    return pa.table({"bucket": t[many, 0], "a": first[many], "b": t[many, 1]})


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line, n, sketch): shingles of a line, repeated ones too, and the set of their hashes modulo SKETCH as bits."""
    for whole in batches:
        data, offsets = text_buffers(whole.column("line"))
        for i, j in blocks(offsets + SKETCH * np.arange(len(offsets)), 8 << 20):  # the bits count too
            h, rows = shingles(padded(data, int(offsets[i]), int(offsets[j])), offsets[i : j + 1] - offsets[i])
            bits = np.zeros((j - i) * SKETCH, bool)
            bits[np.repeat(np.arange(j - i) * SKETCH, np.diff(rows)) + (h & np.uint32(SKETCH - 1))] = True
            sketch = np.packbits(bits, bitorder="little")
            at = pa.array(np.arange(j - i + 1, dtype=np.int32) * (SKETCH // 8))
            binary = pa.Array.from_buffers(pa.binary(), j - i, [None, at.buffers()[1], pa.py_buffer(sketch)])
            yield pa.RecordBatch.from_arrays([whole.column("id").slice(i, j - i), whole.column("line").slice(i, j - i), pa.array(np.diff(rows).astype(np.int32)), binary], ["id", "line", "n", "sketch"])


def may_reach(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of at most n_a and n_b shingles can have a similarity of THRESHOLD. Each bit that only one sketch has
    stands for a shingle at least that only its line has, so no pair that reaches it is refused."""
    only_a, only_b = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a)))
    shared = np.minimum(n_a - only_a, n_b - only_b)
    return shared >= THRESHOLD * (shared + only_a + only_b)


def likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, n_a, sketch_a, n_b, sketch_b) that sketches leave."""

    def words(column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        return np.frombuffer(data[int(offsets[0]) : int(offsets[-1])], np.uint64).reshape(len(column), -1)

    for batch in batches:
        if len(batch):
            n_a, n_b = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 4))
            kept = pa.array(np.flatnonzero(may_reach(n_a, words(batch.column(3)), n_b, words(batch.column(5)))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])


def exact_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct shingles of each text as sorted (row << 32 | number of the shingle), and the rows' offsets. A shingle is
    packed in one word, CODE_BITS a character, and numbered, so equal numbers are equal shingles; None if the texts have
    more kinds of characters than these tell apart."""
    data, offsets = text_buffers(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    at, code = characters(padded(data, lo, hi), hi - lo, offsets[:-1] - lo)
    kinds = np.flatnonzero(np.bincount(code)) if len(code) else code
    if len(kinds) > 1 << CODE_BITS:
        return None
    number = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, np.int64)
    number[kinds] = np.arange(len(kinds))
    c, rows = number[code], np.searchsorted(at, offsets - lo)
    count = np.maximum(np.diff(rows) - SHINGLE + 1, 0)
    first = np.arange(count.sum()) + np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    packed = np.zeros(len(first), np.int64)
    for k in range(SHINGLE):
        packed = (packed << CODE_BITS) | c[first + k]
    keys = np.sort((np.repeat(np.arange(len(texts), dtype=np.uint64), count) << S32) | pd.factorize(packed)[0].astype(np.uint64))
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]  # np.unique hashes, which takes many times as long
    return keys, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << S32)


def shared_counts(keys: np.ndarray, edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers rows a[i] and b[i] have in common."""
    size = np.diff(edges)
    out = np.zeros(len(a), np.int64)
    for i, j in blocks(np.concatenate([[0], np.cumsum(size[a] + size[b])]), 1_000_000):
        nth = np.arange(j - i, dtype=np.uint64) << S32
        both = []
        for side in (a[i:j], b[i:j]):
            n = size[side]
            at = np.arange(n.sum()) + np.repeat(edges[:-1][side] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both.append((keys[at] & np.uint64(0xFFFFFFFF)) | np.repeat(nth, n))
        merged = np.sort(np.concatenate(both))
        same = merged[1:][merged[1:] == merged[:-1]] >> S32
        out[i:j] = np.bincount(same.astype(np.int64), minlength=j - i)
    return out


def jaccard_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of pairs of lines whose sets of shingles have a Jaccard similarity of THRESHOLD at least."""

    def of(line: str) -> set[str]:
        return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}

    for whole in batches:
        lengths = np.diff(text_buffers(whole.column(2))[1]) + np.diff(text_buffers(whole.column(3))[1])
        for i, j in blocks(np.concatenate([[0], np.cumsum(lengths)]), 1 << 20):
            batch = whole.slice(i, j - i)
            ids, first, at = np.unique(np.concatenate([np.asarray(batch.column(0)), np.asarray(batch.column(1))]), return_index=True, return_inverse=True)
            own, a, b = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)), at[: j - i], at[j - i :]
            if (found := exact_shingles(own)) is not None:
                size, both = np.diff(found[1]), shared_counts(*found, a, b)
                x, y = size[a], size[b]
            else:
                sets = [of(line) for line in own.to_pylist()]
                x, y, both = (np.array([f(sets[u], sets[v]) for u, v in zip(a, b, strict=True)]) for f in (lambda s, t: len(s), lambda s, t: len(t), lambda s, t: len(s & t)))
            kept = pa.array(np.flatnonzero(both >= THRESHOLD * (x + y - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])


def across(table: pa.Table) -> pa.Table:
    """(a, b) of lines of one bucket in different components that sketches leave: in whole buckets, or between two blocks
    of one large bucket."""
    t = table.combine_chunks()
    order = np.argsort(np.asarray(t.column("bucket")), kind="stable")
    bucket, ids, root, n, block = (np.asarray(t.column(c))[order].astype(np.int64) for c in ("bucket", "id", "root", "n", "block"))
    data, offsets = text_buffers(t.column("sketch"))
    sketch = np.frombuffer(data[int(offsets[0]) : int(offsets[-1])], np.uint64).reshape(len(ids), -1)[order]
    found: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], ids[:0])]

    def test(x: np.ndarray, y: np.ndarray) -> None:
        for k in range(0, len(x), PAIRS):
            u, v = x[k : k + PAIRS], y[k : k + PAIRS]
            two = root[u] != root[v]
            u, v = u[two], v[two]
            likely = may_reach(n[u], sketch[u], n[v], sketch[v])
            u, v = ids[u[likely]], ids[v[likely]]
            found.append((np.minimum(u, v), np.maximum(u, v)))

    i, j = (t.column(c)[0].as_py() for c in ("i", "j"))
    if i == j:
        at, d = np.arange(len(ids)), 1
        while len(at := at[at + d < len(ids)]):
            at = at[bucket[at] == bucket[at + d]]
            test(at, at + d)
            d += 1
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left:
            test(np.full(len(right), x), right)
    a, b = map(np.concatenate, zip(*found, strict=True))
    return pa.table({"a": a, "b": b})


def similar_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, id2, root, root2) of lines in components of two different lines or more, but for the roots."""
    spark = lines.sparkSession
    n = parts(docs, PART_ROWS)
    bounded(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            once = np.sort(np.unique(ids, return_index=True)[1])
            if len(once) < len(ids):
                batch, ids = batch.take(pa.array(once)), ids[once]
            data, offsets = text_buffers(batch.column("line"))
            keys, own = [], []
            for i, j in blocks(offsets, 1 << 17):
                text, at = padded(data, int(offsets[i]), int(offsets[j])), offsets[i : j + 1] - offsets[i]
                c, ends = mixed_characters(text, at)
                h, rows = shingles_of(c, ends, SHINGLE)
                short, long = kinds_of(h, rows)
                for wanted, w in ((short, SHINGLE), (long, LONG_SHINGLE)):
                    if wanted.any():
                        # shingles don't reach into the next row, so characters of other rows can go first
                        k = band_keys(signatures(*(of_rows(h, rows, wanted) if w == SHINGLE else shingles_of(*of_rows(c, ends, wanted), w))))
                        keys.append(k.ravel())
                        own.append(np.repeat(ids[i:j][wanted], BANDS))
            if keys:
                yield from shards(np.concatenate(keys), [np.concatenate(own)], n)

    members = written(lines.select("id", "line").mapInArrow(lean(sign), "part int, data binary").groupBy("part").applyInArrow(lean_group(buckets), "bucket long, a long, b long"))
    wanted = written(members.select(F.col("b").alias("id")).distinct())
    texts = lines.select("id", "line").join(sized(wanted), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    texts = written(texts.mapInArrow(lean(sketched), "id long, line string, n int, sketch binary"))

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(texts.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)), s)
        return pairs.select("a", "b", *(f"{c}_{s}" for s in "ab" for c in columns))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = written(sides(pairs.distinct(), "n", "sketch").mapInArrow(lean(likely_pairs), "a long, b long"))
        out = written(sides(likely, "line").mapInArrow(lean(jaccard_pairs), "a long, b long"))
        discard(likely)
        return out

    # Each bucket's least line against the others; then, in buckets that this leaves in several components, all pairs
    # across components. A pair that is already connected can't change the components, so this equals trying all pairs.
    edges = verified(members.filter("a < b").select("a", "b"))
    roots = written(components(edges))
    labelled = members.join(sized(roots).select(F.col("id").alias("b"), "root"), "b", "left").select("bucket", "a", "b", F.coalesce("root", "b").alias("root"))
    # all against the least are tested, so only what differs from it is left, in buckets of several components
    rest = written(labelled.filter("b <> a").select("bucket", "b", "root"))
    mixed = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("k"))
    # a large bucket is cut in k blocks, and each pair of blocks is a group; small ones share groups
    groups = max(1, rest.count() // BUCKET_BLOCK)
    cut = rest.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("b", F.lit(3)), "k").cast("int"))
    cut = cut.join(texts.select(F.col("id").alias("b"), "n", "sketch"), "b").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.select(F.when(F.col("k") > 1, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(groups))).alias("group"), "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("block"), F.col("b").alias("id"), "root", "n", "sketch")
    cross = written(cut.groupBy("group", "i", "j").applyInArrow(lean_group(across), "a long, b long"))
    if not cross.isEmpty():
        more = written(sides(cross.distinct(), "line").mapInArrow(lean(jaccard_pairs), "a long, b long"))
        if not more.isEmpty():
            roots = written(components(edges.unionByName(more)))
    own = texts.select("id", F.xxhash64(F.lit(1), "line").alias("id2"))
    out = written(roots.join(own, "id").join(own.select(F.col("id").alias("root"), F.col("id2").alias("root2")), "root").select("id", "id2", "root", "root2"))
    discard(members, wanted, texts, edges, rest, cross, roots)
    return out


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, line_no, kept_doc_id, kept_line_no) of each line that goes and the line that stays for it."""
    lines = lines_of(docs)
    roots = similar_lines(docs, lines)
    places = lines.select("doc_id", "rk", "line_no", "id", "id2").join(sized(roots), ["id", "id2"], "left")
    places = written(places.select("doc_id", "rk", "line_no", F.coalesce("root", "id").alias("root"), F.coalesce("root2", "id2").alias("root2")))
    discard(roots)
    first = places.groupBy("root", "root2").agg(F.min(F.struct("doc_id", "rk", "line_no")).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("root", "root2", "kept")
    out = places.join(first, ["root", "root2"]).filter(~(F.col("rk").eqNullSafe(F.col("kept.rk")) & (F.col("line_no") == F.col("kept.line_no"))))
    return out.select("doc_id", "rk", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without duplicate lines in their texts. A row whose lines that aren't blank all go is a copy and goes too;
    rows that lose no line stay as they are, null texts among them. n_chars, if there, is the new length."""
    gone = written(duplicate_lines(docs).groupBy("rk").agg(F.collect_set("line_no").alias("gone")))
    key, own, taken, lines = fresh(docs, "key", "rk", "gone", "lines")
    gone = gone.select(F.col("rk").alias(own), F.col("gone").alias(taken))
    rows = without_rows(docs).withColumn(key, row_key(docs)).join(gone, F.col(key) == F.col(own), "left")
    cut = F.split("text", "\n", -1)
    rows = rows.filter(F.col(taken).isNull() | (F.size(F.filter(cut, lambda line: ~blank(line))) > F.size(taken)))
    # a column of its own, as a lambda would split the text again for each line
    rows = rows.withColumn(lines, F.when(F.col(taken).isNotNull(), cut))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(taken)), lambda i: F.get(F.col(lines), i))
    rows = rows.withColumn("text", F.when(F.col(taken).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(taken).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return rows.select(*(f"`{c}`" for c in docs.columns))
