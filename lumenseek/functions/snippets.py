"""Snippets: matching lines with context and byte spans, their ranks, and merging those that overlap.

Line arithmetic is SQL; span finding, ranks and the realigned merge run in Arrow batches over one page's files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.language import SPECIAL

Span = tuple[int, int]


@dataclass
class Snippet:
    start_line: int
    end_line: int
    match_line: int
    text: str
    spans: list[Span] = field(default_factory=list)


def line_regex_flags(pattern: str, case_sensitive: bool) -> re.Pattern[str]:
    """A highlight pattern for one line. Alternatives of plain terms go longest first, as the longest match counts."""
    terms = plain_terms(pattern)
    body = "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) if terms else pattern.replace("(?m)", "")
    return re.compile(body, 0 if case_sensitive else re.IGNORECASE)


def plain_terms(pattern: str) -> list[str] | None:
    """The terms that a highlight pattern was made of; None if it isn't plain (an escape of an ordinary character, or an
    empty alternative)."""
    terms, held, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i == len(pattern) or pattern[i] not in SPECIAL:
                return None
            held += pattern[i]
        elif c == "|":
            if not held:
                return None
            terms.append(held)
            held = ""
        else:
            held += c
        i += 1
    return [*terms, held] if held else None


def extract(text: str | None, pattern: str, context: int, case_sensitive: bool = False) -> list[Snippet]:
    """Each line that matches, with context lines around it and the spans of its matches, in bytes of the snippet."""
    rx = line_regex_flags(pattern, case_sensitive)
    lines = (text or "").split("\n")
    out = []
    for n, line in enumerate(lines):
        if not rx.search(line):
            continue
        first, last = max(0, n - context), min(len(lines) - 1, n + context)
        before = sum(len(x.encode()) + 1 for x in lines[first:n])
        spans, at = [], 0
        while at <= len(line) and (m := rx.search(line, at)):
            spans.append((before + len(line[: m.start()].encode()), before + len(line[: m.end()].encode())))
            at = m.end() if m.end() > m.start() else m.start() + 1
        out.append(Snippet(first + 1, last + 1, n + 1, "\n".join(lines[first : last + 1]), spans))
    return out


def literal_spans(text: str, terms: list[str], case_sensitive: bool) -> list[Span] | None:
    """Places of each term, overlaps between terms kept; None where letter case of non-ASCII text would matter."""
    if not case_sensitive:
        if not text.isascii() or not all(t.isascii() for t in terms):
            return None
        text, terms = text.lower(), [t.lower() for t in terms]
    raw, found = text.encode(), set()
    for t in map(str.encode, terms):
        at = raw.find(t)
        while at >= 0:
            found.add((at, at + len(t)))
            at = raw.find(t, at + len(t))
    return sorted(found)


def normalized_spans(text: str, spans: list[Span], pattern: str, case_sensitive: bool) -> list[Span]:
    terms = plain_terms(pattern)
    return (literal_spans(text, terms, case_sensitive) or spans) if terms else spans


def coverage(text: str, pattern: str, case_sensitive: bool) -> tuple[int, int] | None:
    """(terms that the text has, terms)."""
    terms = plain_terms(pattern)
    if terms is None:
        return None
    terms = sorted(set(terms))
    if not case_sensitive:
        if not text.isascii() or not all(t.isascii() for t in terms):
            return None
        text, terms = text.lower(), [t.lower() for t in terms]
    return sum(t in text for t in terms), len(terms)


_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def exact_spans(text: str, spans: list[Span]) -> int:
    """Spans that no identifier byte touches from outside."""
    raw = text.encode()
    return sum(1 for s, e in spans if s <= e <= len(raw) and not (s and raw[s - 1] in _WORD) and not (e < len(raw) and raw[e] in _WORD))


def rank(text: str, spans: list[Span], is_definition: bool, pattern: str, case_sensitive: bool) -> tuple[bool, bool, int, int, int, int]:
    """(definition, all terms, terms, whole-word matches, matches, signs of code); higher is better."""
    seen = coverage(text, pattern, case_sensitive)
    many = seen is not None and seen[1] > 1
    return is_definition, many and seen[0] == seen[1], seen[0] if many else 0, exact_spans(text, spans), len(spans), sum(text.count(c) for c in ":=()")


def end_line(text: str, start: int) -> int:
    """The last line's number; a last newline begins no line."""
    n = text.count("\n") + (not text.endswith("\n")) if text else 0
    return start + max(0, n - 1)


def _lines(s: Snippet) -> list[tuple[str, list[Span]]]:
    out, at = [], 0
    for line in s.text.split("\n"):
        stop = at + len(line.encode())
        out.append((line, [(a - at, b - at) for a, b in s.spans if a >= at and b <= stop]))
        at = stop + 1
    return out


def _shift(known: dict[int, tuple[str, list[Span]]], start: int, lines: list[tuple[str, list[Span]]]) -> int:
    """How far lines have to move to agree best with those known: three for an equal line, minus four for another."""
    best = (0, 0)
    for shift in (0, -1, 1, -2, 2, -3, 3):
        score = 0
        for i, (line, _) in enumerate(lines):
            old = known.get(start + i + shift, ("", []))[0]
            if old and line:
                score += 3 if old == line else -4
        if score > best[0]:
            best = (score, shift)
    return best[1]


def merge(snippets: list[Snippet], aligned: bool = False) -> list[Snippet]:
    """Snippets that overlap or touch as one; of a line that several have, the one with most spans counts. aligned: all are
    of one text and their line numbers are right, so that a line which repeats the one before stays a line of its own."""
    out: list[Snippet] = []
    known: dict[int, tuple[str, list[Span]]] = {}
    span = (0, 0, 0)

    def flush() -> None:
        if not known:
            return
        text, spans, at = [], [], 0
        for n in range(span[0], span[1] + 1):
            line, own = known.get(n, ("", []))
            spans += [(at + a, at + b) for a, b in own]
            text.append(line)
            at += len(line.encode()) + 1
        out.append(Snippet(span[0], span[1], span[2], "\n".join(text), spans))
        known.clear()

    for s in sorted(snippets, key=lambda s: (s.start_line, s.end_line)):
        if not known or s.start_line > span[1] + 1:
            flush()
            span = (s.start_line, s.end_line, s.match_line)
        lines = _lines(s)
        first = s.start_line + (0 if aligned else _shift(known, s.start_line, lines))
        for i, (line, own) in enumerate(lines):
            if first + i not in known or len(known[first + i][1]) < len(own):
                known[first + i] = (line, own)
        span = (min(span[0], first), max(span[1], first + len(lines) - 1), span[2])
    flush()
    return out


def segments(text: str, spans: list[Span]) -> list[tuple[str, bool]]:
    """Text cut at byte spans, with whether each piece is highlighted; spans off character limits are moved inwards."""
    raw, out, at = text.encode(), [], 0
    for s, e in sorted(spans):
        while s < len(raw) and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        s, e = max(s, at), min(e, len(raw))
        if s >= e:
            continue
        if s > at:
            out.append((raw[at:s].decode(), False))
        out.append((raw[s:e].decode(), True))
        at = e
    if at < len(raw):
        out.append((raw[at:].decode(), False))
    return out


SCHEMA = "file_id long, nth int, start_line int, end_line int, match_line int, content_text string, match_spans array<struct<start:int,end:int>>"


def page_snippets(results: DataFrame, chunk_texts: DataFrame, starts: DataFrame, definitions: DataFrame | None = None, context: int = 3) -> DataFrame:
    """(file_id, nth, start_line, end_line, match_line, content_text, match_spans): merged snippets of each result's first
    matching chunk; nth is 1 for the best. A chunk without a matching line is a snippet whole. definitions(content_hash, line):
    lines where a term is defined."""
    rows = results.select("file_id", "content_hash", "chunk_index", "chunk_hash", "highlight_pattern", "highlight_case_sensitive")
    rows = rows.join(chunk_texts, "chunk_hash").join(starts.select("content_hash", "chunk_index", "start_line"), ["content_hash", "chunk_index"])
    if definitions is not None:
        lines = definitions.groupBy("content_hash").agg(F.collect_set("line").alias("defined"))
        rows = rows.join(lines, "content_hash", "left")
    else:
        rows = rows.withColumn("defined", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                pattern, cs, base = r["highlight_pattern"], r["highlight_case_sensitive"], r["start_line"]
                found = extract(r["text_content"], pattern, context, cs)
                for s in found:
                    s.spans = normalized_spans(s.text, s.spans, pattern, cs)
                    s.start_line, s.match_line = s.start_line + base - 1, s.match_line + base - 1
                    s.end_line = end_line(s.text, s.start_line)
                if not found:
                    text = r["text_content"]
                    found = [Snippet(base, end_line(text, base), base, text)]
                defined = set(r["defined"] or ())
                merged = merge(found, aligned=True)
                ranks = {id(s): rank(s.text, s.spans, any(s.start_line <= d <= s.end_line for d in defined), pattern, cs) for s in merged}
                for nth, s in enumerate(sorted(merged, key=lambda s: (*(-int(x) for x in ranks[id(s)]), s.start_line)), 1):
                    out.append((r["file_id"], nth, s.start_line, s.end_line, s.match_line, s.text, [{"start": a, "end": b} for a, b in s.spans]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file_id", "nth", "start_line", "end_line", "match_line", "content_text", "match_spans"])

    return rows.select("file_id", "highlight_pattern", "highlight_case_sensitive", "start_line", "text_content", "defined").mapInArrow(run, SCHEMA)
