"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a block lie one after the other in one linked list of bytes. Each merge rank has a bucket of
list positions; a three-level bitmap says which buckets hold any, and find-first-set picks the least rank. A bucket's
positions are taken at once: entries whose pair has changed since are stale and skipped, of overlapping pairs the
leftmost goes first, and the pairs that a merge makes (always of a higher rank) go to their buckets. The work is linear in
the bytes but for sorting inside buckets, however long a pre-token is.

Defined cases: a null text has null ids; an empty one has none. Bytes that aren't valid UTF-8 are encoded as they are.
Nothing is cut: ids cover the whole text, however long, and decoding them gives its bytes back. Repeated rows each give
their row; an empty table gives no rows; columns other than keys and text don't matter, keys may not be named like results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded, hash_spans, lean, padded, text_buffers, valid

NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded together, and that are cut into pre-tokens at once (some forty times as many bytes).
BLOCK, PIECE = 4 << 20, 1 << 19
SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def classes() -> np.ndarray:
    """The pre-tokenizer's class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x32000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def characters(data: np.ndarray, n: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and code points of the characters of padded UTF-8; a byte that fits nowhere joins its neighbour."""
    head = (data[:n] & 0xC0) != 0x80
    head[bounds[bounds < n]] = True
    at = np.flatnonzero(head)
    b0 = data[at].astype(np.int32)
    code = b0.copy()
    for low, high, width in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        own = np.flatnonzero((b0 >= low) & (b0 < high))
        if len(own):
            c = b0[own] & (0x3F >> width)
            for k in range(1, width + 1):
                c = (c << 6) | (data[at[own] + k] & 0x3F)
            code[own] = c
    return at, np.minimum(code, 0x10FFFF)


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin, for rows of padded data, piece by piece."""
    pieces = []
    for i, j in blocks(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        pieces.append(_pretokens(data[lo : hi + 16], hi - lo, offsets[i : j + 1] - lo).astype(np.int32) + np.int32(lo))
    return np.concatenate(pieces) if pieces else np.zeros(0, np.int32)


def _pretokens(data: np.ndarray, n: int, offsets: np.ndarray) -> np.ndarray:
    """Contractions, runs of letters, of numbers or of other characters with a blank before them, and white space."""
    at, code = characters(data, n, offsets[:-1])
    m = len(at)
    if not m:
        return at
    kind = classes()[code]
    row_start = np.zeros(m + 1, bool)
    row_start[np.searchsorted(at, offsets)] = True
    change = np.ones(m, bool)
    change[1:] = (kind[1:] != kind[:-1]) | row_start[1:m]
    blank_before = np.zeros(m, bool)
    blank_before[1:] = (code[:-1] == 32) & ~row_start[1:m]
    solid = kind != SPACE
    begin = change & ~(solid & blank_before)
    begin[:-1] |= ~solid[:-1] & solid[1:] & ~row_start[1:m]
    quote = np.flatnonzero((code == 39) & change & ~blank_before)
    if len(quote):
        ext = np.concatenate([code, np.zeros(3, np.int32)])
        edge = np.concatenate([row_start, np.ones(3, bool)])
        one, two = ext[quote + 1], ext[quote + 2]
        one = np.where(edge[quote + 1], 0, one)
        two = np.where(edge[quote + 1] | edge[quote + 2], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, length in ((single, 2), (double & ~single, 3)):
            q = quote[which]
            begin[q + 1] = False
            after = q + length
            begin[after[after < m]] = True
        # what follows a contraction's letters begins a token only where white space doesn't lend its blank: it never does
    return at[begin]


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels of 64 ways each."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[dict[int, int]] = [{}, {}, {}]
        self.top = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        own = self.buckets.get(rank)
        if own is not None:
            own.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word = rank >> 6
            before = level.get(word, 0)
            level[word] = before | (1 << (rank & 63))
            if before:
                return
            rank = word
        self.top |= 1 << rank

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        if not self.top:
            return None
        rank = (self.top & -self.top).bit_length() - 1
        for level in reversed(self.levels):
            bits = level[rank]
            rank = (rank << 6) | ((bits & -bits).bit_length() - 1)
        out, rest = self.buckets.pop(rank), rank
        for level in self.levels:
            word = rest >> 6
            level[word] &= ~(1 << (rest & 63))
            if level[word]:
                return rank, out
            del level[word]
            rest = word
        self.top &= ~(1 << rest)
        return rank, out

    def push_groups(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else ranks
        for s, e in zip(cuts, np.append(cuts[1:], len(ranks)), strict=True) if len(ranks) else ():
            self.push(int(ranks[s]), positions[s:e])


class ByteBpe:
    """Merges of a vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.size = max(vocab.values()) + 1
        pieces = [b""] * self.size
        for piece, i in vocab.items():
            if all(c in to_byte for c in piece):
                pieces[i] = bytes(to_byte[c] for c in piece)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum(lengths)])
        self.of_byte = np.full(256, -1, np.int32)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.of_byte[p[0]] = i
        first, second, made = (np.array([vocab[x] for x in col], np.int32) for col in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.made = made
        rank = np.arange(len(merges), dtype=np.int32)
        order = np.argsort(first, kind="stable")
        self.by_first = (np.searchsorted(first[order], np.arange(self.size + 1)), second[order], rank[order])
        order = np.argsort(second, kind="stable")
        self.by_second = (np.searchsorted(second[order], np.arange(self.size + 1)), first[order], rank[order])
        self.byte_pairs = np.full((256, 256), NONE, np.int32)
        byte_of = {int(self.of_byte[b]): b for b in range(256)}
        for a, b, r in zip(first.tolist(), second.tolist(), range(len(merges)), strict=True):
            if a in byte_of and b in byte_of:
                self.byte_pairs[byte_of[a], byte_of[b]] = r

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[offsets[i]:offsets[i+1]], none of them empty, and the words' offsets among the ids."""
        n = len(data)
        tok = np.append(self.of_byte[data], np.int32(self.size))  # position n is the end of every word
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[offsets[1:] - 1] = n
        prv = np.arange(-1, n, dtype=np.int32)
        prv[offsets[:-1]] = n
        prv = np.append(prv, np.int32(n))
        rank_at = np.full(n + 1, NONE, np.int32)
        rank_at[: n - 1] = self.byte_pairs[data[:-1], data[1:]]
        rank_at[offsets[1:] - 1] = NONE
        alive = np.ones(n, bool)
        queue = RankQueue()
        has = np.flatnonzero(rank_at < NONE).astype(np.int32)
        queue.push_groups(rank_at[has], has)
        del has
        right, left = np.full(self.size + 1, NONE, np.int32), np.full(self.size + 1, NONE, np.int32)
        while (top := queue.pop()) is not None:
            rank, parts = top
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[rank_at[p] == rank]  # stale entries
            if not len(p):
                continue
            if len(p) > 1:
                p = np.sort(p)
                p = p[np.concatenate([[True], p[1:] != p[:-1]])]
                overlap = np.concatenate([[False], p[1:] == nxt[p[:-1]]])
                if overlap.any():  # of a run of overlapping pairs the first, third, ...
                    i = np.arange(len(p))
                    p = p[(i - np.maximum.accumulate(np.where(overlap, 0, i))) % 2 == 0]
            new = int(self.made[rank])
            q = nxt[p]
            after = nxt[q]
            tok[p] = new
            alive[q] = False
            rank_at[q] = NONE
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            s, e = self.by_first[0][new], self.by_first[0][new + 1]
            right[self.by_first[1][s:e]] = self.by_first[2][s:e]
            to_right = right[tok[after]]
            right[self.by_first[1][s:e]] = NONE
            s, e = self.by_second[0][new], self.by_second[0][new + 1]
            left[self.by_second[1][s:e]] = self.by_second[2][s:e]
            to_left = left[tok[before]]
            left[self.by_second[1][s:e]] = NONE
            rank_at[p] = to_right
            rank_at[before] = to_left
            rank_at[n] = NONE
            a, b = to_right < NONE, to_left < NONE
            queue.push_groups(np.concatenate([to_right[a], to_left[b]]), np.concatenate([p[a], before[b]]))
        live = np.flatnonzero(alive)
        return tok[live], np.searchsorted(live, offsets)

    def encode_rows(self, data: np.ndarray, n: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of padded data, and the rows' offsets among them."""
        starts = pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], np.int32(n))
        h = hash_spans(data, starts, ends - starts)
        code, distinct = pd.factorize(h)
        del h
        where = np.empty(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]  # each word's first place
        same = bytes_equal(data, starts, ends, where[code])
        if not same.all():  # a collision of hashes: such words stand alone
            odd = np.flatnonzero(~same)
            code[odd] = len(where) + np.arange(len(odd))
            where = np.append(where, odd)
        length = (ends - starts)[where]
        del same, ends
        words, at = gathered(data, starts[where], length)
        ids, id_at = self.encode_words(words, at)
        count = np.diff(id_at)[code]
        out, out_at = gathered(ids, id_at[:-1][code], count)
        return out, out_at[np.searchsorted(starts, offsets)]

    def decode_ids(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.piece_bytes, self.piece_at[ids], self.piece_at[ids + 1] - self.piece_at[ids])[0]


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[starts[i]:starts[i]+lengths[i]] one after the other, and offsets."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return source[np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)], at


def bytes_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span at first."""
    length = ends - starts
    same = length == length[first]
    view = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    live, k = np.flatnonzero(same & (first != np.arange(len(first)))), 0
    mask = np.array([(1 << (8 * j)) - 1 for j in range(9)], np.uint64)
    while len(live):
        left = length[live] - k
        x = (view[starts[live] + k] ^ view[starts[first[live]] + k]) & mask[np.minimum(left, 8)]
        same[live[x != 0]] = False
        live, k = live[(left > 8) & (x == 0)], k + 8
    return same


@cache
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """keys, token_ids, n_tokens, round_trip (whether decoding the ids gave the text's bytes back; null for a null text).

    path: the vocabulary file, at the same place on all executors. One scan, no shuffle."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(k))
            there = valid(batch.column(k))
            for i, j in blocks(offsets, BLOCK):
                lo, hi = int(offsets[i]), int(offsets[j])
                own = padded(data, lo, hi)
                ids, at = bpe.encode_rows(own, hi - lo, offsets[i : j + 1] - lo)
                back = bpe.decode_ids(ids)
                ok = np.array([len(back) == hi - lo] * (j - i))
                if ok.any() and not np.array_equal(back, own[: hi - lo]):
                    wrong = np.add.reduceat(np.append(back != own[: hi - lo], False), np.minimum(offsets[i:j] - lo, hi - lo))
                    ok = (wrong == 0) | (np.diff(offsets[i : j + 1]) == 0)
                null = ~there[i:j]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:k]), lists, pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(ok, mask=null)], [*keys, "token_ids", "n_tokens", "round_trip"])

    types = dict(docs.dtypes)
    bounded(docs.sparkSession)
    return docs.select(*keys, "text").mapInArrow(lean(run), ", ".join(f"`{c}` {types[c]}" for c in keys) + ", token_ids array<int>, n_tokens int, round_trip boolean")


def decode(ids: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """keys, text of the rows of ids(keys, token_ids); null ids have a null text."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            column = batch.column(k)
            at = np.asarray(column.offsets).astype(np.int64)
            lengths = bpe.piece_at[1:] - bpe.piece_at[:-1]
            flat = np.asarray(column.values)[at[0] : at[-1]]
            back = bpe.decode_ids(flat)
            edge = np.concatenate([[0], np.cumsum(lengths[flat])])[at - at[0]]
            text = pa.StringArray.from_buffers(len(column), pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(back.tobytes()))
            text = pa.array([None] * len(column), pa.string()) if column.null_count == len(column) else pa.compute.if_else(column.is_valid(), text, None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], text], [*keys, "text"])

    types = dict(ids.dtypes)
    bounded(ids.sparkSession)
    return ids.select(*keys, "token_ids").mapInArrow(lean(run), ", ".join(f"`{c}` {types[c]}" for c in keys) + ", text string")
