"""The search language: text -> tokens -> tree -> disjunction of conjunctive plans. Plain Python, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import product


class SearchSyntaxError(ValueError):
    """The text isn't a query."""


class PlanError(ValueError):
    """The query is well formed but can't be planned."""


class UnsupportedError(PlanError):
    """The query asks for what the engine doesn't do."""


# ---- lexical rules


@dataclass(frozen=True)
class Token:
    value: str
    quoted_colon: bool = False  # its first colon stands inside quotes, so it isn't a filter


_GAPS = " \t\n\r"


def tokenize(text: str) -> list[Token]:
    """Quotes of both kinds hold blanks, and a backslash escapes inside them. After an unquoted colon a value runs to the
    next blank whatever it holds. Parentheses outside are tokens of their own."""
    out: list[Token] = []
    held: list[str] = []
    colon: bool | None = None

    def flush() -> None:
        nonlocal colon
        if held:
            word = "".join(held)
            out.append(Token("or") if word in ("or", "OR") else Token(word, bool(colon)))
            held.clear()
            colon = None

    i, quote = 0, ""
    while i < len(text):
        c = text[i]
        i += 1
        if quote:
            if c == "\\":
                if i < len(text):
                    held.append(text[i])
                i += 1
            elif c == quote:
                quote = ""
                flush()
            else:
                if c == ":" and colon is None:
                    colon = True
                held.append(c)
        elif c in "\"'":
            quote = c
        elif c == ":":
            if colon is None:
                colon = False
            held.append(c)
            if i < len(text) and text[i] not in "\"'":
                while i < len(text) and not text[i].isspace():
                    held.append(text[i])
                    i += 1
                flush()
        elif c in _GAPS:
            flush()
        elif c in "()":
            flush()
            out.append(Token(c))
        else:
            held.append(c)
    flush()
    return out


# ---- syntax tree


@dataclass(frozen=True)
class Filter:
    kind: str  # content repo file lang branch regex case type historical
    value: str | bool


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    node: Node


@dataclass(frozen=True)
class And:
    nodes: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    nodes: tuple[Node, ...]


Node = Filter | Term | Not | And | Or

_KINDS = {"content": "content", "c": "content", "repo": "repo", "r": "repo", "file": "file", "f": "file", "path": "file", "lang": "lang", "l": "lang", "branch": "branch", "b": "branch"}
_TYPES = ("filematch", "filename", "file", "repo")
_FLAGS = {"yes": True, "true": True, "1": True, "no": False, "false": False, "0": False}


def make_filter(key: str, value: str) -> Filter:
    if key in _KINDS:
        return Filter(_KINDS[key], value)
    if key == "regex":
        return Filter("regex", line_regex(value))
    if key == "case" and value in ("yes", "no", "auto"):
        return Filter("case", value)
    if key in ("type", "t") and value in _TYPES:
        return Filter("type", value)
    if key == "historical" and value.lower() in _FLAGS:
        return Filter("historical", _FLAGS[value.lower()])
    raise SearchSyntaxError(f"unknown filter or value: {key}:{value}")


def line_regex(raw: str) -> str:
    """A whole-line pattern. Escapes of tab and backslash are decoded, newlines are refused, parentheses are literal, and
    an anchor counts for the line's start or end wherever it stands outside a class."""
    text, i = [], 0
    while i < len(raw):
        c = raw[i]
        i += 1
        if c != "\\":
            text.append(c)
            continue
        if i == len(raw):
            raise SearchSyntaxError("the regex ends inside an escape")
        c = raw[i]
        i += 1
        if c in "()":
            raise SearchSyntaxError("parentheses in a regex are literal and can't be escaped")
        text.append({"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}.get(c, "\\" + c))
    decoded = "".join(text)
    if "\n" in decoded or "\r" in decoded:
        raise SearchSyntaxError("a regex matches inside one line")
    out: list[str] = []
    start = end = inside = escaped = False
    for c in decoded:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "[]":
            inside = c == "["
        elif not inside and c in "()":
            out.append("\\")
        elif not inside and c in "^$":
            start, end = start or c == "^", end or c == "$"
            continue
        out.append(c)
    return f"(?m)^{'' if start else '.*'}{''.join(out)}{'' if end else '.*'}$"


class _Reader:
    def __init__(self, tokens: list[Token], strict: bool) -> None:
        self.tokens, self.at, self.strict = tokens, 0, strict

    def peek(self) -> str | None:
        return self.tokens[self.at].value if self.at < len(self.tokens) else None

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise SearchSyntaxError("the query is empty")
        self.at += 1
        return self.tokens[self.at - 1]

    def leaf(self, text: str, quoted_colon: bool) -> Node:
        key, colon, value = text.partition(":")
        return make_filter(key, value) if colon and not quoted_colon else Term(text)

    def one(self) -> Node:
        token = self.take()
        if token.value == "(":
            return self.group_strict() if self.strict else self.group_compat()
        if token.value.startswith("-"):
            if self.strict and token.value == "-" and self.peek() == "(":
                self.take()
                return Not(self.group_strict())
            return Not(self.leaf(token.value[1:], token.quoted_colon))
        return self.leaf(token.value, token.quoted_colon)

    def group_compat(self) -> Node:
        """Tokens up to the closing parenthesis joined by blanks, cut at the first closing one and read anew."""
        parts, open_ = [], 1
        while open_ and self.at < len(self.tokens):
            word = self.take().value
            open_ += word.count("(") - word.count(")")
            parts.append(word)
        inner = " " + " ".join(parts)
        inner = inner[: inner.find(")")] if ")" in inner else inner
        whole = parse(inner)
        if " or " in inner:
            return Or(tuple(parse(part.strip()) for part in inner.split(" or ")))
        return whole

    def group_strict(self) -> Node:
        node = self.any_of()
        if self.peek() != ")":
            raise SearchSyntaxError("a parenthesis isn't closed")
        self.take()
        return node

    def any_of(self) -> Node:
        found = [self.all_of()]
        while self.peek() == "or":
            self.take()
            found.append(self.all_of())
        return found[0] if len(found) == 1 else Or(tuple(found))

    def all_of(self) -> Node:
        found = []
        while self.peek() not in (None, ")", "or"):
            found.append(self.one())
        if not found:
            raise SearchSyntaxError("the query is empty")
        return found[0] if len(found) == 1 else And(tuple(found))

    def compat(self) -> Node:
        """Pieces apart by `or` are required together: alternatives exist inside parentheses alone."""
        pieces: list[Node] = []
        while self.peek() is not None:
            if self.peek() == ")":
                raise SearchSyntaxError("a parenthesis isn't opened")
            nodes: list[Node] = []
            while self.peek() not in (None, ")"):
                nodes.append(self.one())
                if self.peek() == "or":
                    self.take()
                    break
            pieces.append(nodes[0] if len(nodes) == 1 else And(tuple(nodes)))
            if self.peek() == "or":
                self.take()
        if not pieces:
            raise SearchSyntaxError("the query is empty")
        return pieces[0] if len(pieces) == 1 else And(tuple(pieces))


def parse(text: str, strict: bool = False) -> Node:
    """The tree of a query. Not strict: `or` between top-level pieces means both, and groups end at the first closing
    parenthesis. Strict: a proper grammar with nesting, `a or b` at the top, and negated groups of one term."""
    reader = _Reader(tokenize(text), strict)
    if not strict:
        return reader.compat()
    node = reader.any_of()
    if reader.peek() is not None:
        raise SearchSyntaxError("a parenthesis isn't opened")
    return node


# ---- plans


@dataclass(frozen=True)
class Content:
    text: str
    regex: bool = False


@dataclass(frozen=True)
class Plan:
    """A conjunction. Lists of the same filter are alternatives, but for globs, which all have to match."""

    required: tuple[Content, ...] = ()
    excluded: tuple[Content, ...] = ()
    repos: tuple[str, ...] = ()
    no_repos: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    no_globs: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    no_langs: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()
    no_branches: tuple[str, ...] = ()
    case: str | None = None
    kind: str | None = None
    historical: bool | None = None
    highlight: str = field(default="", compare=False)

    @property
    def case_sensitive(self) -> bool:
        """yes and no as said; auto if a plain required term has an upper-case ASCII letter; else insensitive."""
        if self.case == "auto":
            return any(not t.regex and re.search("[A-Z]", t.text) for t in self.required)
        return self.case == "yes"


_LISTS = ("required", "excluded", "repos", "no_repos", "globs", "no_globs", "langs", "no_langs", "branches", "no_branches")
_FIELDS = {"repo": "repos", "file": "globs", "lang": "langs", "branch": "branches"}
SPECIAL = frozenset("\\.+*?^$()[]{}|")


def escape_regex(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def glob_to_like(glob: str) -> str:
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in glob)


def escape_like(text: str) -> str:
    return "".join("\\" + c if c in "%_\\" else c for c in text)


def _leaf_plan(node: Filter | Term, negated: bool) -> Plan:
    if isinstance(node, Term) or node.kind == "content":
        text = node.text if isinstance(node, Term) else node.value
        if len(text) < 3:
            raise PlanError("search terms have three characters at least")
        return Plan(**{"excluded" if negated else "required": (Content(text),)})
    if node.kind == "regex":
        return Plan(**{"excluded" if negated else "required": (Content(node.value, True),)})
    if node.kind in _FIELDS:
        value = glob_to_like(node.value) if node.kind == "file" else node.value
        return Plan(**{("no_" if negated else "") + _FIELDS[node.kind]: (value,)})
    if negated:
        raise PlanError("case filters can't be negated") if node.kind == "case" else UnsupportedError(f"{node.kind} filters can't be negated")
    return Plan(**{{"case": "case", "type": "kind", "historical": "historical"}[node.kind]: node.value})


def _merged(a: Plan, b: Plan) -> Plan:
    out = {k: getattr(a, k) + getattr(b, k) for k in _LISTS}
    for k in ("case", "kind", "historical"):
        x, y = getattr(a, k), getattr(b, k)
        if k == "case" and "auto" in (x, y) and None not in (x, y):
            x, y = (y, y) if x == "auto" else (x, x)
        if x is not None and y is not None and x != y:
            raise PlanError(f"{k} filters contradict each other: {x}, {y}")
        out[k] = y if x is None else x
    return Plan(**out)


def disjuncts(node: Node) -> list[Plan]:
    if isinstance(node, And):
        out = [Plan()]
        for add in map(disjuncts, node.nodes):
            out = [_merged(a, b) for a, b in product(out, add)]
        return out
    if isinstance(node, Or):
        return [p for n in node.nodes for p in disjuncts(n)]
    if isinstance(node, Not):
        if not isinstance(node.node, Filter | Term):
            raise UnsupportedError("only terms and filters can be negated")
        return [_leaf_plan(node.node, True)]
    return [_leaf_plan(node, False)]


def _finished(p: Plan) -> Plan:
    if not p.required:
        raise PlanError("a search term is required")
    if p.kind not in (None, "filematch"):
        raise UnsupportedError(f"type:{p.kind} isn't supported")
    shown = "|".join(t.text if t.regex else escape_regex(t.text) for t in p.required)
    return replace(p, highlight=shown, historical=bool(p.historical), **{k: tuple(dict.fromkeys(getattr(p, k))) for k in _LISTS})


# ---- requests

PAGE_SIZE = 25
FETCH_CAPS = {False: 5000, True: 1000}  # by whether there is a regex
PLAN_ROWS = {False: 5000, True: 1000}
FILE_CAP = 25_000
FACTORS = {False: 6, True: 2}


@dataclass(frozen=True)
class Request:
    text: str
    plans: tuple[Plan, ...]
    page: int = 1
    page_size: int = PAGE_SIZE

    @property
    def has_regex(self) -> bool:
        return any(t.regex for p in self.plans for t in p.required)

    @property
    def fetch_limit(self) -> int:
        return min(FETCH_CAPS[self.has_regex], (self.page + 1) * self.page_size * FACTORS[self.has_regex] + 1)

    @property
    def file_limit(self) -> int:
        return min(self.fetch_limit, FILE_CAP)

    @property
    def plan_rows(self) -> int:
        return PLAN_ROWS[self.has_regex]

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size

    @property
    def limit_plus_one(self) -> int:
        return self.page_size + 1

    @property
    def symbol_terms(self) -> list[str]:
        """Lower-case required plain terms that look like symbols, once each."""
        return list(dict.fromkeys(t.text.lower() for p in self.plans for t in p.required if not t.regex and looks_like_symbol(t.text)))

    @property
    def definition_terms(self) -> list[str]:
        """What definitions are looked up by: symbol terms and the last part of qualified ones."""
        return list(dict.fromkeys(t.rpartition("::")[2] for t in self.symbol_terms if t.rpartition("::")[2]))


def request(text: str, page: int = 1, page_size: int = PAGE_SIZE, strict: bool = False) -> Request:
    return Request(text, tuple(map(_finished, disjuncts(parse(text, strict)))), max(1, page), max(1, page_size))


_SYMBOL = re.compile(r"(?=.*[A-Za-z_])[A-Za-z0-9_:.$#]+")


def looks_like_symbol(text: str) -> bool:
    return len(text.encode()) <= 128 and bool(_SYMBOL.fullmatch(text))


_FILTER_PREFIXES = ("repo:", "file:", "path:", "lang:", "branch:", "regex:", "case:", "content:")


def looks_like_filter(text: str) -> bool:
    return any(word.lstrip("-").lower().startswith(_FILTER_PREFIXES) for word in text.split())


# ---- regex dialect

_CLASSES = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print"}


def java_regex(pattern: str, case_sensitive: bool) -> str:
    """A POSIX-style pattern of line_regex for the JVM: only newlines end lines, POSIX classes and word anchors are
    rewritten, negated classes stay inside the line."""
    body = pattern.removeprefix("(?m)")
    body = re.sub(r"\[:(\^?)(\w+):\]", lambda m: ("\\P{" if m[1] else "\\p{") + _CLASSES.get(m[2], m[2]) + "}", body)
    body = re.sub(r"\\([mMyY])", lambda m: {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B"}[m[1]], body)
    body = re.sub(r"(?<!\\)\[\^", r"[^\\n", body)
    return f"(?md{'' if case_sensitive else 'iu'}){body}"


# ---- building query text

def quote_if_needed(text: str) -> str:
    if text and not re.search(r"[\s\"'():]", text) and text not in ("or", "OR"):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def compile_query(query: str = "", **filters: list[str] | str | bool | None) -> str:
    """Query text of a search and filters by key; keys that begin with not_ are negated."""
    parts = [query] if query else []
    for key, values in filters.items():
        if values is None or values == []:
            continue
        for v in values if isinstance(values, list) else [values]:
            word = ("yes" if v else "no") if isinstance(v, bool) else quote_if_needed(str(v))
            parts.append(f"{'-' if key.startswith('not_') else ''}{key.removeprefix('not_')}:{word}")
    return " ".join(parts)
