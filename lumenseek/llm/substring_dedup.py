"""Substring dedup by repeated-phrase automata.

1. Winnowed anchors (hashes of ANCHOR words, the least of each WINDOW + 1 - ANCHOR in a row) of all texts are grouped;
   every passage of WINDOW words that two different texts share has an anchor that both select, as has one text that
   holds it twice.
2. Around recurring anchors all windows of WINDOW words are hashed and grouped; a window that two different texts have,
   or one text at two places that don't overlap, recurs. Of each maximal run of recurring windows those at its ends and a winnowed choice between, close enough to
   overlap, are passages; so is a whole text of WINDOW words that several rows have.
3. The documents are cut in shards of bounded size. The first words of the passages that a shard's documents can hold,
   told by anchors, are compiled into the shard's Aho-Corasick automaton (pyahocorasick).
4. All documents are streamed through their shard's automaton, once each, so work follows the corpus and not its square.
   A hit is confirmed by comparing the whole passage's hash and its ends at word limits; a passage is confirmed if it
   occurs in two rows, or at two places of one that don't overlap.
5. Overlapping occurrences in a document become one span. An occurrence that overlaps the passage's first place counts
   from that place's end, so that removing the others leaves the first whole.

Passages of a fixed length keep the hits in proportion to the repeated text; maximal runs as passages would nest in each
other, by the square of a group of near copies.

Defined cases: null, empty and short texts have no passage; rows with the same doc_id and text are reported as one, but
repeat each other; words are apart by ASCII white space, and passages match byte by byte, inner white space included;
an empty table gives no rows; is_first goes by the least (doc_id, row key, start), so copies of a row with one doc_id are
all first; doc_id has any type that can be ordered; a very long text is cut in words and streamed whole; other columns
don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import C1, SPACE, blocks, bounded, hash_spans, lean, lean_group, mix, padded, parts, text_buffers, word_spans, written
from .line_dedup import shards, unpack

WINDOW = 50
ANCHOR = 25
PHRASE = 8
#: Bytes of documents in a shard; what repeats in them bounds its automaton (up to some 60 bytes a character).
SHARD_BYTES = 8 << 20
#: Longs in a broadcast table; beyond that the join shuffles.
BROADCAST_ENTRIES = 4_000_000
#: Documents for each part of the anchors' and windows' keys.
PART_ROWS = 20_000
#: Documents that may share a key in one part; a key of more lies in as many parts as that takes.
WAY_ROWS = 1_000_000
BLANK = np.frombuffer(SPACE.tobytes(), bool)

_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_B, n))])
    return mix((sums[k:] - sums[: n - k + 1]) * _powers(_BI, n - k + 1) + np.uint64(k * int(C1) % (1 << 64)))


def split(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends of rows i to j, and the rows' offsets among the words."""
    lo, hi = int(offsets[i]), int(offsets[j])
    own, rows = padded(data, lo, hi), offsets[i : j + 1] - lo
    starts, ends = word_spans(own, hi - lo, rows[:-1], BLANK)
    return hash_spans(own, starts, ends - starts), starts + lo, ends + lo, np.searchsorted(starts, rows)


def window_rows(rows: np.ndarray, k: int) -> np.ndarray:
    """For each window start, whether k words from it are in one row."""
    n = int(rows[-1])
    inside = np.ones(max(0, n - k + 1), bool)
    for d in range(1, k):
        at = rows[1:] - d
        at = at[(at >= np.maximum(rows[:-1], 0)) & (at < len(inside))]
        inside[at] = False
    return inside


def _slide(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """f over each k consecutive values."""
    span = 1
    while 2 * span <= k:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (k - span)], x[k - span :]) if span < k else x


def anchors(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the words at which the selected anchors begin."""
    span = WINDOW - ANCHOR + 1
    h = window_hashes(words, ANCHOR)
    if len(h) < span:
        return np.zeros(0, int)
    whole = window_rows(rows, WINDOW)
    least = _slide(h, span, np.minimum)
    least = np.where(whole[: len(least)], least, np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), span, np.maximum)
    return np.flatnonzero((most == h) & (h != 0))


def chosen(places: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of runs of consecutive window starts: both ends, and each whose hash is the least of WINDOW - 1 in a row of its run.
    Copies choose alike, and neighbours overlap."""
    span = WINDOW - 1
    edge = np.diff(places, prepend=places[0] - 2) > 1
    keep = edge | np.append(edge[1:], True)
    if len(places) >= span:
        own = h[places]
        least = _slide(own, span, np.minimum)
        least = np.where(places[span - 1 :] - places[: len(least)] == span - 1, least, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        keep |= (_slide(np.concatenate([pad, least, pad]), span, np.maximum) == own) & (own != 0)
    return places[keep]


def apart(texts: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a text has the hash at two places that are WINDOW words apart at least, as 0 or 1 for each row."""
    order = np.lexsort((at, h, texts))
    texts, h, at = texts[order], h[order], at[order]
    new = np.flatnonzero((np.diff(texts, prepend=-1) != 0) | np.append(True, h[1:] != h[:-1])[: len(h)])
    size = np.diff(new, append=len(h))
    out = np.zeros(len(h), np.int64)
    out[order] = np.repeat(at[new + size - 1] - at[new] >= WINDOW, size)
    return out


def recurring(table: pa.Table) -> pa.Table:
    """(key, th, value, recurs): recurs for keys that two different texts of the part have, or one twice; words are
    [key, text, value, twice]."""
    t = unpack(table, 4)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    new = np.append(True, t[1:, 0] != t[:-1, 0])[: len(t)]
    group = np.cumsum(new) - 1
    other = np.append(False, (t[1:, 0] == t[:-1, 0]) & (t[1:, 1] != t[:-1, 1]))[: len(t)]
    recurs = np.bincount(group, weights=other | (t[:, 3] > 0))[group] > 0 if len(t) else np.zeros(0, bool)
    return pa.table({"key": t[:, 0], "th": t[:, 1], "value": t[:, 2], "recurs": recurs})


def recurring_everywhere(sent: DataFrame, ways: int) -> DataFrame:
    """(th, value) of keys that two different texts have, or one twice, of sent(part, data). A key that many texts have lies
    in several parts; what doesn't recur in its own part may with another, which two texts' hashes for each key tell."""
    found = sent.groupBy("part").applyInArrow(lean_group(recurring), "key long, th long, value long, recurs boolean")
    if ways == 1:
        return found.filter("recurs").select("th", "value")
    found = written(found)
    keys = found.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo < hi").select("key")
    rest = found.filter("not recurs").join(keys, "key", "left_semi")
    return found.filter("recurs").unionByName(rest).select("th", "value")


def passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, phrase, n_chars, key) of the passages to look for, and (th, key) of the texts that may hold those of a key.
    pid is the xxHash64 of the passage; its key is the least anchor of its first WINDOW words. Winnowing makes every text
    with a passage select that anchor too, so no text with it is left out. Copies of one text have its hash as a key."""
    n = parts(docs, PART_ROWS)
    ways = max(1, -(-docs.count() // WAY_ROWS))
    bounded(docs.sparkSession)
    rows = docs.select("text").filter("text is not null").select(F.xxhash64("text").alias("th"), "text")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            th = np.asarray(batch.column(0))
            keys, texts, twice = [], [], []
            for i, j in blocks(offsets, 1 << 20):
                words, _, _, edges = split(data, offsets, i, j)
                at = anchors(words, edges)
                row = np.searchsorted(edges, at, "right") - 1
                keys.append(window_hashes(words, ANCHOR)[at])
                texts.append(th[i:j][row])
                twice.append(apart(row, keys[-1], at))
            k, t = np.concatenate(keys), np.concatenate(texts)
            yield from shards(k, [t, k, np.concatenate(twice)], n, t, ways)

    found = recurring_everywhere(rows.mapInArrow(lean(select), "part int, data binary"), ways)
    near = written(found.groupBy("th").agg(F.collect_set("value").alias("keys")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            th, wanted = np.asarray(batch.column(0)), batch.column(2)
            keys, texts, places, twice = [], [], [], []
            for i in range(len(batch)):
                words, *_ = split(data, offsets, i, i + 1)
                h = window_hashes(words, ANCHOR)
                at = np.flatnonzero(np.isin(h, np.array(wanted[i].as_py(), np.int64).view(np.uint64)))
                w = window_hashes(words, WINDOW)
                mark = np.zeros(len(w) + WINDOW, np.int64)
                np.add.at(mark, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
                np.add.at(mark, np.minimum(at + 1, len(w)), -1)
                place = np.flatnonzero(np.cumsum(mark)[: len(w)] > 0)
                keys.append(w[place])
                texts.append(np.full(len(place), th[i]))
                places.append(place)
                twice.append(apart(np.zeros(len(place), np.int64), w[place], place))
            t = np.concatenate(texts)
            yield from shards(np.concatenate(keys), [t, np.concatenate(places), np.concatenate(twice)], n, t, ways)

    def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of places as runs: first place and length of each, one after the other."""
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                p = np.sort(np.array(places, np.int64))
                at = np.flatnonzero(np.diff(p, prepend=-2) > 1)
                out.append(np.column_stack([p[at], np.diff(at, append=len(p))]).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["th", "runs"])

    def join(texts: DataFrame, entries: str) -> DataFrame:
        size = texts.agg(F.count("*") + F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()[0]
        return rows.join(F.broadcast(texts) if size <= BROADCAST_ENTRIES else texts, "th")

    again = recurring_everywhere(join(near, "keys").mapInArrow(lean(windows), "part int, data binary"), ways)
    runs = again.groupBy("th").agg(F.collect_set("value").alias("places")).mapInArrow(in_runs, "th long, runs array<int>")
    whole = rows.groupBy("th").count().filter("count > 1").select("th", F.lit(True).alias("whole"))
    spans = written(runs.join(whole, "th", "full").select("th", F.coalesce("runs", F.array().cast("array<int>")).alias("runs"), F.coalesce("whole", F.lit(False)).alias("whole")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out: dict[str, list] = {"pid": [], "phrase": [], "n_chars": [], "key": []}
            seen = set()
            for i, (th, own, whole_text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if th in seen:
                    continue
                seen.add(th)
                words, starts, ends, _ = split(data, offsets, i, i + 1)
                h = window_hashes(words, ANCHOR).view(np.int64)
                places = np.concatenate([np.arange(p, p + k) for p, k in zip(own[::2], own[1::2], strict=True)]) if own else np.zeros(0, int)
                ranges = [(p, p + WINDOW, False) for p in chosen(places, window_hashes(words, WINDOW)).tolist()] if len(places) else []
                if whole_text and len(starts) >= WINDOW:
                    ranges += [(0, len(starts), False), (0, len(starts), True)]
                for s, e, to_copies in ranges:
                    text = data[starts[s] : ends[e - 1]].tobytes()
                    out["pid"].append(xxhash.xxh64_intdigest(text) - (1 << 63))
                    out["phrase"].append(data[starts[s] : ends[s + PHRASE - 1]].tobytes().decode(errors="replace"))
                    out["n_chars"].append(len(text.decode(errors="replace")))
                    out["key"].append(th if to_copies else int(h[s : s + WINDOW - ANCHOR + 1].view(np.uint64).min().view(np.int64)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("pid", pa.int64()), ("phrase", pa.string()), ("n_chars", pa.int32()), ("key", pa.int64())]))

    found = join(spans, "runs").select("th", "text", "runs", "whole").mapInArrow(lean(cut), "pid long, phrase string, n_chars int, key long").dropDuplicates(["pid", "key"])
    routes = near.select("th", F.explode("keys").alias("key")).unionByName(spans.filter("whole").select("th", F.col("th").alias("key")))
    return written(found), routes


def hits(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, rk, passage, start, end): every place of every passage; start and end are character offsets.

    A shard is so many bytes of documents, by row key, with an automaton of the passages that can be in them."""
    found, routes = passages(docs)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text").filter("text is not null")
    n_shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    rows = rows.withColumn("shard", F.pmod("rk", F.lit(n_shards)))
    wanted = rows.select(F.col("shard").alias("part"), F.xxhash64("text").alias("th")).distinct().join(routes, "th").select("part", "key").distinct()
    wanted = wanted.join(found, "key").select("part", "pid", "phrase", "n_chars").distinct()

    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def scan(docs: pa.Table, own: pa.Table) -> pa.Table:
        of_phrase: dict[str, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for phrase, pid, n_chars in zip(*(own.column(c).to_pylist() for c in ("phrase", "pid", "n_chars")), strict=True):
            of_phrase[phrase][n_chars].add(pid)
        automaton = ahocorasick.Automaton()
        for phrase, sizes in of_phrase.items():
            automaton.add_word(phrase, (len(phrase), sorted(sizes.items())))
        out: list[list] = [[] for _ in range(5)]
        if of_phrase:
            automaton.make_automaton()
            for doc, rk, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "rk", "text")), strict=True):
                for last, (length, sizes) in automaton.iter(text):
                    s = last + 1 - length
                    if s and text[s - 1] not in BLANKS:
                        continue
                    for n_chars, pids in sizes:
                        e = s + n_chars
                        if e > len(text):
                            break
                        if (e == len(text) or text[e] in BLANKS) and (pid := xxhash.xxh64_intdigest(text[s:e].encode()) - (1 << 63)) in pids:
                            for column, v in zip(out, (doc, rk, pid, s, e), strict=True):
                                column.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, [arrow] + [pa.int64()] * 2 + [pa.int32()] * 2, strict=True)], ["doc_id", "rk", "passage", "start", "end"])

    return rows.groupBy("shard").cogroup(wanted.groupBy("part")).applyInArrow(lean_group(scan), f"doc_id {kind.simpleString()}, rk long, passage long, start int, end int")


def occurrences(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, end, is_first): spans, as long as can be, that passages of two rows or places cover. is_first: it is
    the passages' first place by (doc_id, row key, start); without the other spans' text one copy of everything stays."""
    every = written(hits(docs, shard_bytes))
    places = every.groupBy("passage").agg(F.min(F.struct("doc_id", "rk", "start", "end")).alias("first"), F.min("rk").alias("a"), F.max("rk").alias("b"), F.count("*").alias("n"), F.count_distinct("start").alias("starts"), F.max("start").alias("last_start"), F.min("end").alias("first_end"))
    # two different rows, a row that is repeated, or two places in a row that don't overlap
    confirmed = places.filter("a <> b or n > starts or last_start >= first_end").select("passage", "first")
    same, is_first = F.col("rk").eqNullSafe(F.col("first.rk")), F.col("start") == F.col("first.start")
    start = F.when(same & ~is_first, F.greatest("start", "first.end")).otherwise(F.col("start"))
    rows = every.distinct().join(confirmed, "passage").select("doc_id", "rk", start.alias("start"), "end", (same & is_first).alias("is_first"))
    own = Window.partitionBy("rk", "is_first").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)).withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "rk", "is_first", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end", "is_first")


BLANKS = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
