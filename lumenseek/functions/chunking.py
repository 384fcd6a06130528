"""Content-defined chunks of blobs: gear-hash cut points (the published FastCDC scheme), moved to line ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN, AVERAGE, MOST = 64 << 10, 256 << 10, 1 << 20
#: Gear values, one a byte, from a fixed hash.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def _mask(bits: int) -> int:
    """So many bits spread over the upper part of a word."""
    return sum(1 << (63 - (47 * k) // max(bits - 1, 1)) for k in range(bits))


STRICT, LOOSE = _mask(19), _mask(17)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 64 gear values, each shifted left once a byte."""
    h, span = GEAR[data], 1
    while span < 64:
        h[span:] += h[:-span] << np.uint64(span)
        span *= 2
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: the first fitting hash after MIN bytes, under a strict mask up to AVERAGE, a loose one beyond;
    MOST bytes at the latest."""
    raw = np.frombuffer(data, np.uint8)
    h = gear_hashes(raw)
    strict, loose = np.flatnonzero((h & np.uint64(STRICT)) == 0), np.flatnonzero((h & np.uint64(LOOSE)) == 0)
    out, at = [], 0
    while len(raw) - at > MIN:
        stop = min(at + MOST, len(raw))
        mid = min(at + AVERAGE, stop)
        i = np.searchsorted(strict, at + MIN)
        if i < len(strict) and strict[i] < mid:
            cut = int(strict[i]) + 1
        else:
            i = np.searchsorted(loose, mid)
            cut = int(loose[i]) + 1 if i < len(loose) and loose[i] < stop else stop
        out.append(cut)
        at = cut
    if at < len(raw):
        out.append(len(raw))
    return out


def fallback_ranges(data: bytes) -> list[tuple[int, int]]:
    """Whole lines of AVERAGE bytes or a little less; a line that has MOST is cut at a character."""
    out, start = [], 0
    while len(data) - start >= AVERAGE:
        line = data.rfind(b"\n", start, start + AVERAGE)
        if line < 0:
            line = data.find(b"\n", start + AVERAGE, start + MOST)
            stop = line + 1 if line >= 0 else start + MOST
            while line < 0 and stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            stop = min(stop, len(data))
        else:
            stop = line + 1
        out.append((start, stop))
        start = stop
    if start < len(data):
        out.append((start, len(data)))
    return out


def chunk_ranges(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of a text's chunks; a short text is one, an empty one has none."""
    if len(data) < MIN:
        return [(0, len(data))] if data else []
    ends = cut_points(data)
    moved = []
    for e in ends[:-1]:
        line = data.find(b"\n", e)
        moved.append(line + 1 if line >= 0 else e)
    edges = sorted({0, *moved, len(data)})
    ranges = list(zip(edges, edges[1:], strict=False))
    for s, e in ranges:
        try:
            data[s:e].decode()
        except UnicodeDecodeError:
            return fallback_ranges(data)
    return ranges


def count_lines(text: str) -> int:
    return text.count("\n") + (bool(text) and not text.endswith("\n"))


def chunk(blobs: DataFrame) -> DataFrame:
    """(content_hash, chunk_hash, chunk_index, chunk_line_count, text_content) of blobs(content_hash, text); null texts have
    no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                for i, (s, e) in enumerate(chunk_ranges(data)):
                    part = data[s:e]
                    out.append((key, hashlib.sha256(part).hexdigest(), i, count_lines(part.decode()), part.decode()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["content_hash", "chunk_hash", "chunk_index", "chunk_line_count", "text_content"])

    return blobs.select("content_hash", "text").mapInArrow(run, "content_hash string, chunk_hash string, chunk_index int, chunk_line_count int, text_content string")
