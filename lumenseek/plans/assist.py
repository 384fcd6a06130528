"""Helpers around query text: completion, chips, queries from addresses, retention specs, error codes. Plain Python."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from .language import tokenize

_PIECE = re.compile(r"""[()]|(?:"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|[^\s()"'])+""", re.S)
_QUOTED = re.compile(r"""("(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$))""", re.S)
_COMPLETED = {"repo": "repo", "r": "repo", "path": "path", "file": "file", "f": "file", "lang": "lang", "l": "lang", "branch": "branch", "b": "branch", "case": "case", "historical": "historical"}
_TEXT_KEYS = ("regex", "content", "type")


@dataclass(frozen=True)
class Completion:
    mode: str  # none, symbol, or the filter whose value is typed
    term: str = ""
    key: str | None = None
    repos: tuple[str, ...] = ()  # repositories that the query is already limited to
    start: int = 0  # where the word being typed begins


def _start(text: str) -> int:
    if not text or text[-1].isspace():
        return len(text)
    spans = [m.start() for m in re.finditer(r"""(?:"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|[^\s"'])+""", text, re.S)]
    return spans[-1] if spans else len(text)


def completion(text: str) -> Completion:
    """What can be completed at the end of a query. After a blank, nothing typed yet: any symbol."""
    tokens = tokenize(text)
    repos = tuple(value for t in tokens if not t.quoted_colon for key, _, value in [t.value.strip().partition(":")] if key.lower() in ("repo", "r") and value)
    start = _start(text)
    if not text.strip():
        return Completion("none", repos=repos, start=start)
    if text[-1].isspace() or not tokens:
        return Completion("symbol", repos=repos, start=start)
    last = tokens[-1]
    key, colon, value = last.value.partition(":")
    if last.quoted_colon or not colon:
        return Completion("symbol", last.value, repos=repos, start=start)
    if (mode := _COMPLETED.get(key.lower())) is not None:
        return Completion(mode, value.strip().rstrip("*") if mode == "path" else value.strip(), key, repos, start)
    return Completion("none", repos=repos, start=start) if key.lower() in _TEXT_KEYS else Completion("symbol", last.value, repos=repos, start=start)


def completed(text: str, start: int, replacement: str) -> str:
    if start < len(text):
        return text[:start] + replacement
    return text + (" " if text and not text[-1].isspace() else "") + replacement


def pieces(text: str) -> list[str]:
    """Words as they are written, quotes and all; parentheses outside quotes stand alone."""
    return _PIECE.findall(text)


def chips(text: str) -> list[tuple[str, str]]:
    """(label, word) of each filter."""
    out = []
    for word in pieces(text):
        bare = word.removeprefix("-")
        hidden = _QUOTED.sub(lambda m: "\0" * len(m[0]), bare)
        at = hidden.find(":")
        if at > 0 and (value := bare[at + 1 :].strip()):
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out.append((f"{'-' if word != bare else ''}{bare[:at]}: {value}", word))
    return out


def without_word(text: str, word: str) -> str:
    kept = [p for p in pieces(text) if p != word]
    return " ".join(p for i, p in enumerate(kept) if i == 0 or p != kept[i - 1])


def with_word(text: str, word: str) -> str:
    return text if word in pieces(text) else completed(text.rstrip(), len(text.rstrip()), word)


def _filter(key: str, value: str) -> list[str]:
    if not value:
        return []
    quoted = '"' + value.replace('"', '\\"') + '"'
    return [f"{key}:{quoted if re.search(r'\s', value) or '"' in value else value}"]


def query_of_address(path: str) -> str:
    """The filters of a repository page's address (/repo/NAME/tree/BRANCH/PATH; a last slash means a directory)."""
    parts = [unquote(p) for p in path.split("/") if p]
    if len(parts) < 2 or parts[0] != "repo":
        return ""
    words = _filter("repo", parts[1])
    if len(parts) > 3 and parts[2] == "tree":
        words += _filter("branch", parts[3])
        words += _filter("path", "/".join(parts[4:]) + ("/*" if path.endswith("/") and len(parts) > 4 else ""))
    return " ".join(words)


_UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}


def seconds(text: str) -> int:
    """A duration such as 7d, 1h30m or 2 weeks."""
    body = text.strip().lower()
    found = re.findall(r"(\d+)\s*([a-z]+)\s*", body)
    if not found or re.fullmatch(r"(?:\d+\s*[a-z]+\s*)+", body) is None:
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for n, unit in found:
        size = _UNITS.get(unit) or _UNITS.get(unit.removesuffix("s"))
        if size is None:
            raise ValueError(f"not a unit of time: {unit!r}")
        total += int(n) * size
    return total


def snapshot_policy(text: str) -> tuple[int, int]:
    """(interval in seconds, snapshots to keep) of INTERVAL:COUNT, both positive."""
    interval, colon, count = text.partition(":")
    if not colon or not count.strip().isdigit():
        raise ValueError(f"not INTERVAL:COUNT: {text!r}")
    out = seconds(interval), int(count)
    if min(out) < 1:
        raise ValueError("the interval and the count have to be positive")
    return out


def error_code(tool: str, message: str) -> str:
    """A stable code for a tool's error message."""
    said = message.lower()
    if "unknown field `query`" in said and tool in ("search", "file_list"):
        return "search_legacy_query_removed" if tool == "search" else "file_list_invalid_params"
    if any(x in said for x in ("additional properties", "unknown field", "invalid type")):
        return f"{tool}_invalid_params"
    for what in ("repository", "branch"):
        if what in said and "not found" in said:
            return f"{tool}_{what}_not_found"
    if tool == "path_search":
        if "non-empty" in said:
            return "path_search_empty_query"
        if "plain query string" in said:
            return "path_search_invalid_query_syntax"
    return f"{tool}_failed"
