"""Names that source text defines and uses, by language, without a grammar.

A lexer takes strings and comments away; tables say which words of a language open scopes, begin functions or variables,
and how parameters are written. Each name comes with its kind, the namespace around it, line and byte column from 1.
Patterns (match arms, destructuring with defaults) are read as far as their plain names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Reference(NamedTuple):
    name: str
    kind: str
    namespace: str | None
    line: int
    column: int


class Token(NamedTuple):
    text: str
    kind: str  # name, sign, line
    line: int
    column: int


@dataclass(frozen=True)
class Spec:
    separator: str
    types: frozenset[str] = frozenset()  # words whose next name opens a scope
    functions: frozenset[str] = frozenset()
    variables: frozenset[str] = frozenset()
    params: str = ""  # colon: name: type; typed: type name; go: name type; plain: name
    typed: bool = False  # declarations are a type and a name
    declares: bool = False  # prototypes are declarations
    package: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    hash_comments: bool = False
    dash_comments: bool = False
    assigns: bool = False  # a bare assignment defines
    lines_end: bool = False  # statements end with their line


def _w(text: str) -> frozenset[str]:
    return frozenset(text.split())


_C = "auto break case const continue default do else extern for goto if inline register restrict return signed sizeof static switch typedef unsigned volatile while"
_C_TYPES = _w("bool char double float int long short signed unsigned void size_t auto const struct enum union volatile")
_JS = "as async await break case catch continue debugger default delete do else export extends finally for from if implements import in instanceof new null of return static super switch throw true false try typeof undefined void while with yield get set public private protected readonly abstract declare keyof infer is"
_JAVA = "abstract assert break case catch continue default do else extends final finally for if implements import instanceof native new null private protected public return sealed static strictfp super switch synchronized this throw throws transient true false try volatile while yield var permits"
_JAVA_TYPES = _w("boolean byte char double float int long short void var")
_GLSL = _w("void bool int uint float double " + " ".join(f"{p}vec{n}" for p in ("", "b", "i", "u", "d") for n in "234") + " " + " ".join(f"{p}mat{n}" for p in ("", "d") for n in ("2", "3", "4", "2x2", "2x3", "2x4", "3x2", "3x3", "3x4", "4x2", "4x3", "4x4")) + " " + " ".join(f"{p}sampler{k}" for p in ("", "i", "u") for k in ("1D", "2D", "3D", "Cube", "2DRect", "1DArray", "2DArray", "Buffer", "2DMS", "2DMSArray", "CubeArray")) + " sampler2DShadow sampler1DShadow samplerCubeShadow")
_TS = Spec(".", _w("class interface enum namespace module"), _w("function"), _w("let const var type"), "colon", words=_w(_JS + " string number boolean any unknown never object symbol void this"))

SPECS: dict[str, Spec] = {
    "c": Spec("::", _w("struct union enum"), params="typed", typed=True, declares=True, words=_w(_C)),
    "cpp": Spec("::", _w("namespace class struct union enum"), params="typed", typed=True, declares=True, words=_w(_C + " catch constexpr delete explicit final friend mutable new noexcept nullptr operator override private protected public template this throw true false try typename using virtual")),
    "go": Spec(".", functions=_w("func"), variables=_w("var const"), params="go", package=_w("package"), words=_w("break case chan continue default defer else fallthrough for go goto if import interface map range return select struct switch type nil true false int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 string bool byte rune float32 float64 error any"), lines_end=True),
    "js": Spec(".", _w("class"), _w("function"), _w("let const var"), "plain", words=_w(_JS), assigns=True),
    "java": Spec(".", _w("class interface enum record"), params="typed", typed=True, package=_w("package"), words=_w(_JAVA)),
    "nix": Spec(".", words=_w("let in with rec inherit if then else assert or true false null import"), hash_comments=True),
    "objc": Spec(".", params="typed", typed=True, words=_w(_C + " nil self super id instancetype YES NO nonatomic strong weak copy assign readonly")),
    "php": Spec("\\", _w("class trait interface enum"), _w("function fn"), _w("const"), "plain", words=_w("abstract and array as break callable case catch continue declare default do echo else elseif extends final finally for foreach global if implements include instanceof insteadof isset list new null or print private protected public readonly require require_once return self static switch throw true false try unset use var while yield int string bool float mixed void namespace php"), hash_comments=True, assigns=True),
    "proto": Spec(".", _w("message enum service rpc"), package=_w("package"), words=_w("syntax import option returns repeated optional required oneof map reserved extensions stream string bytes bool double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64")),
    "rust": Spec("::", _w("mod struct enum trait union"), _w("fn"), _w("let const static type"), "colon", words=_w("as async await break continue crate dyn else extern false for if impl in loop match move mut pub ref return self Self super true unsafe use where while i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str")),
    "swift": Spec(".", _w("class struct enum protocol extension actor"), _w("func"), _w("var let"), "colon", words=_w("as break case catch continue default defer do else fallthrough false for guard if import in inout internal is nil open override private public repeat rethrows return self Self static super switch throw throws true try where while mutating final")),
    "ts": _TS,
    "glsl": Spec("::", _w("struct"), params="typed", typed=True, words=_w("attribute const uniform varying in out inout buffer shared layout centroid flat smooth highp mediump lowp precision if else for while do return break continue discard switch case default true false")),
}
ALIASES = {"c++": "cpp", "javascript": "js", "jvm": "java", "py": "python", "protobuf": "proto", "typescript": "ts", "objective-c": "objc"}
TYPE_WORDS = {"c": _C_TYPES, "cpp": _C_TYPES | _w("wchar_t string"), "java": _JAVA_TYPES, "glsl": _GLSL, "objc": _C_TYPES | _w("id instancetype BOOL")}
BUILT_IN = {k: v - _w("struct enum union const auto signed unsigned volatile") for k, v in TYPE_WORDS.items()}


@cache
def _taken(language: str) -> frozenset[str]:
    """Words that are no names in a language."""
    return SPECS[language].words | BUILT_IN.get(language, frozenset())


_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"[\w.]*")
_SIGNS = ("===", "!==", "::", ":=", "->", "=>", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "&&", "||", "..")
_LONG = frozenset(s[0] for s in _SIGNS)
#: Signs that neither a longer sign nor a comment or string begins with.
_SHORT = frozenset("()[]{};,?@$%^~\\")


def lex(source: str, language: str) -> list[Token]:
    """Names and signs outside strings and comments, and a token for each line's end."""
    spec = SPECS.get(language)
    hashes = language == "python" or bool(spec and spec.hash_comments)
    dashes = language == "lua"
    slashes = language not in ("python", "lua", "nix")
    out: list[Token] = []
    i, line, start, n = 0, 1, 0, len(source)
    plain = source.isascii()

    def column(at: int) -> int:
        return at - start + 1 if plain else len(source[start:at].encode()) + 1

    def skip(to: int) -> int:
        nonlocal line, start
        breaks = source.count("\n", i, to)
        if breaks:
            line += breaks
            start = source.rfind("\n", i, to) + 1
        return to

    def until(mark: str, at: int) -> int:
        found = source.find(mark, at)
        return n if found < 0 else found + len(mark)

    while i < n:
        c = source[i]
        if c.isalpha() or c == "_":
            m = _NAME.match(source, i)
            out.append(Token(m[0], "name", line, i - start + 1 if plain else column(i)))
            i = m.end()
        elif c in _SHORT:
            out.append(Token(c, "sign", line, i - start + 1 if plain else column(i)))
            i += 1
        elif c == "\n":
            out.append(Token("\n", "line", line, column(i)))
            i += 1
            line, start = line + 1, i
        elif c.isspace():
            i += 1
        elif slashes and source.startswith("//", i) or hashes and c == "#" or dashes and source.startswith("--", i):
            if dashes and source.startswith("--[[", i):
                i = skip(until("]]", i))
            else:
                end = source.find("\n", i)
                i = n if end < 0 else end
        elif language not in ("python", "lua") and source.startswith("/*", i):
            i = skip(until("*/", i + 2))
        elif source.startswith(('"""', "'''"), i) and language in ("python", "swift", "java"):
            i = skip(until(source[i : i + 3], i + 3))
        elif language == "nix" and source.startswith("''", i):
            i = skip(until("''", i + 2))
        elif c in "\"`" or c == "'" and not (language == "rust" and not re.match(r"'(\\.|[^\\'])'", source[i : i + 4])):
            j = i + 1
            while j < n and source[j] != c and not (source[j] == "\n" and c != "`"):
                j += 2 if source[j] == "\\" else 1
            i = skip(min(j + 1, n))
        elif m := _NAME.match(source, i):
            out.append(Token(m[0], "name", line, column(i)))
            i = m.end()
        elif c.isdigit():
            i = _NUMBER.match(source, i).end()
        else:
            sign = next((s for s in _SIGNS if source.startswith(s, i)), c) if c in _LONG else c
            out.append(Token(sign, "sign", line, column(i)))
            i += len(sign)
    return out


#: Words that may stand before the type of a pointer's declaration, and directives whose line names nothing.
DECLARING = ("const", "static", "extern", "volatile", "unsigned", "signed", "struct", "union", "enum", "inline", "constexpr", "mutable", "register", "class", ":")
ACTING = frozenset("{};@-+#")  # signs that do something on their own
DIRECTIVES = ("include", "import", "pragma", "version", "extension", "error", "line")


class _Walk:
    def __init__(self, tokens: list[Token], spec: Spec, language: str, hint: str | None) -> None:
        self.t, self.spec, self.language = tokens, spec, language
        taken = _taken(language)
        self.texts = [t.text for t in tokens]
        self.names = [t.kind == "name" and t.text not in taken for t in tokens]
        self.base: list[str] = [hint] if hint else []
        self.stack: list[tuple[str | None, str]] = []  # (name, what kind of body)
        self.pending: tuple[str | None, str] | None = None
        self.defined: set[int] = set()
        self.found: list[Reference] = []

    def namespace(self, *more: str) -> str | None:
        parts = [*self.base, *(n for n, _ in self.stack if n), *more]
        return self.spec.separator.join(parts) or None

    def add(self, i: int, kind: str, *inside: str) -> None:
        if i not in self.defined:
            self.defined.add(i)
            t = self.t[i]
            self.found.append(Reference(t.text, kind, self.namespace(*inside), t.line, t.column))

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.names) and self.names[i]

    def solid(self, i: int, step: int) -> int:
        """The next token that isn't a line's end."""
        i += step
        while 0 <= i < len(self.t) and self.t[i].kind == "line":
            i += step
        return i

    def close(self, i: int) -> int:
        """The sign that closes the bracket at i."""
        depth = 0
        for k in range(i, len(self.t)):
            if self.t[k].text in "([{<" if self.text(i) == "<" else self.t[k].text in ("(", "[", "{"):
                depth += 1
            elif self.t[k].text in (")", "]", "}") or self.text(i) == "<" and self.t[k].text == ">":
                depth -= 1
                if depth <= 0:
                    return k
            elif self.text(i) == "<" and self.t[k].text in (";", "{"):
                return i
        return len(self.t)

    def parameters(self, i: int, *inside: str) -> int:
        """Names between the parenthesis at i and its end, which is returned."""
        end = self.close(i)
        part: list[int] = []
        depth = 0
        for k in range(i + 1, end + 1):
            x = self.text(k)
            if k == end or x == "," and depth == 0:
                self.parameter(part, inside)
                part = []
                continue
            depth += (x in ("(", "[", "{", "<")) - (x in (")", "]", "}", ">"))
            part.append(k)
        return end

    def parameter(self, part: list[int], inside: tuple[str, ...]) -> None:
        part = [k for k in part if self.t[k].kind != "line"]
        style = self.spec.params
        names = [k for k in part if self.is_name(k)]
        if not names:
            return
        cut = next((x for x, k in enumerate(part) if self.text(k) == "="), len(part))
        head = part[:cut]
        colon = next((x for x, k in enumerate(head) if self.text(k) == ":"), None)
        if style == "colon":
            for k in [k for k in (head if colon is None else head[:colon]) if self.is_name(k)][-1 if self.language == "swift" else 0 :]:
                self.add(k, "definition", *inside)
        elif style == "plain":
            for k in head:
                if self.is_name(k) and (self.language != "php" or self.text(k - 1) == "$"):
                    self.add(k, "definition", *inside)
        elif style == "go":
            if len([k for k in head if self.t[k].kind == "name" or self.text(k) in ("]", ")")]) > 1 and self.is_name(head[0]) and self.text(head[0] + 1) != ".":
                self.add(head[0], "definition", *inside)
        elif style == "typed":
            last = [k for k in head if self.is_name(k)]
            words = [k for k in head if self.t[k].kind == "name"]
            if last and len(words) > 1 and last[-1] == words[-1]:
                self.add(last[-1], "definition", *inside)

    def opens(self, i: int, name: str | None, what: str) -> None:
        """The next brace opens a scope of that name."""
        self.pending = (name, what)

    def run(self) -> list[Reference]:
        i = 0
        while i < len(self.t):
            i = max(i + 1, self.step(i))
        return self.found

    def step(self, i: int) -> int:
        t, spec = self.t[i], self.spec
        if t.kind == "line":
            if spec.lines_end and self.pending and self.pending[1] == "function":
                self.pending = None
            return i + 1
        if t.kind == "sign":
            if t.text not in ACTING:
                return i + 1
            if t.text == "{":
                self.stack.append(self.pending or (None, ""))
                self.pending = None
            elif t.text == "}":
                if self.stack:
                    self.stack.pop()
            elif t.text == ";":
                self.pending = None
            elif t.text == "@" and self.language == "objc":
                return self.objc_at(i)
            elif t.text in "-+" and self.language == "objc" and self.text(self.solid(i, 1)) == "(" and self.text(i - 1) in ("", "\n"):
                return self.objc_method(i)
            elif t.text == "#" and self.text(i + 1) in DIRECTIVES:
                while i < len(self.t) and self.t[i].kind != "line":
                    i += 1
                return i
            elif t.text == "#" and self.text(i + 1) == "define" and self.is_name(i + 2):
                self.add(i + 2, "definition")
                return i + 3
            return i + 1
        after = self.solid(i, 1)
        before = self.text(self.solid(i, -1))
        if t.text in spec.package and self.t[after : after + 1]:
            return self.package(i)
        if self.language == "php" and t.text == "namespace":
            return self.package(i)
        if self.language == "go" and t.text == "type":
            return self.go_types(i)
        if t.text in spec.types and before not in (".", "->") and self.is_name(after):
            if self.language in ("c", "cpp", "glsl") and t.text in ("struct", "union", "enum", "class") and self.text(self.solid(after, 1)) not in ("{", ":", ";", "final") or before == "enum":
                if before != "enum":
                    return i + 1  # a type in use
            self.add(after, "definition")
            name = self.text(after)
            self.opens(after, name, t.text if before != "enum" else "enum")
            k = self.solid(after, 1)
            if self.text(k) == "<":
                k = self.solid(self.close(k), 1)
            if self.text(k) == "(" and self.language == "java":
                return self.parameters(k, name) + 1
            if t.text == "rpc":
                self.pending = None
            return after + 1
        if t.text in spec.functions and before != ".":
            return self.function(i)
        if self.language == "swift" and t.text in ("init", "deinit") and before != ".":
            self.add(i, "definition")
            self.opens(i, t.text, "function")
            return self.parameters(after, t.text) + 1 if self.text(after) == "(" else i + 1
        if self.language == "rust" and t.text == "impl":
            return self.impl(i)
        if self.language == "rust" and t.text == "macro_rules" and self.text(after) == "!":
            self.add(self.solid(after, 1), "definition")
            return self.solid(after, 1) + 1
        if t.text in spec.variables and before != ".":
            return self.variables(i)
        if t.text == "for" and self.language in ("rust", "swift"):
            k = after
            while k < len(self.t) and self.text(k) not in ("in", "{", "\n"):
                if self.is_name(k):
                    self.add(k, "definition")
                k += 1
            return k
        if self.is_name(i):
            self.name(i, before, after)
        return i + 1

    def package(self, i: int) -> int:
        k = self.solid(i, 1)
        parts = []
        while self.is_name(k) or self.text(k) in (".", "\\", "::"):
            if self.is_name(k):
                parts.append(k)
            k += 1
        if self.language == "go":
            for p in parts[:1]:
                self.add(p, "definition")
        if parts:
            names = [self.text(p) for p in parts]
            if self.language == "proto":
                self.add(parts[0], "definition")
                names = [".".join(names)]
            self.defined.update(parts)
            self.base = [*self.base, *names]
        return k

    def go_types(self, i: int) -> int:
        name = self.solid(i, 1)
        if self.is_name(name):
            self.add(name, "definition")
            self.opens(name, self.text(name), "interface" if self.text(name + 1) == "interface" else "struct" if self.text(name + 1) == "struct" else "type")
            return name + 1
        return i + 1

    def function(self, i: int) -> int:
        k = self.solid(i, 1)
        inside: tuple[str, ...] = ()
        receiver = None
        if self.text(k) == "*" or self.text(k) == "&":
            k = self.solid(k, 1)
        if self.language == "go" and self.text(k) == "(":
            receiver, end = k, self.close(k)
            owner = [x for x in range(k + 1, end) if self.is_name(x)]
            inside = (self.text(owner[-1]),) if owner else ()
            k = self.solid(end, 1)
        if not self.is_name(k):
            if self.text(k) == "(" and receiver is None:
                self.parameters(k)
                self.opens(k, None, "function")
            return k if self.text(k) != "(" else k + 1
        name = self.text(k)
        self.add(k, "definition", *inside)
        if receiver is not None:
            self.parameters(receiver, *inside, name)
        full = self.spec.separator.join([*inside, name])
        self.opens(k, full, "function")
        p = self.solid(k, 1)
        if self.text(p) == "<":
            p = self.solid(self.close(p), 1)
        return self.parameters(p, full) + 1 if self.text(p) == "(" else k + 1

    def impl(self, i: int) -> int:
        k, name = self.solid(i, 1), None
        if self.text(k) == "<":
            k = self.solid(self.close(k), 1)
        while k < len(self.t) and self.text(k) not in ("{", ";", "where"):
            if self.text(k) == "for":
                name = None
            elif self.is_name(k):
                self.add(k, "reference")
                name = self.text(k) if self.text(k - 1) in ("::", "\n") or name is None else name
            elif self.text(k) == "<":
                k = self.close(k)
            k += 1
        self.opens(k, name, "impl")
        return k

    def variables(self, i: int) -> int:
        """let (a, b): T = ..., var x, y int, const x = 1, type T = ..."""
        k, depth, typed = self.solid(i, 1), 0, False
        while k < len(self.t):
            x = self.text(k)
            if x in ("=", ";", "in", "of", ":=") and depth == 0 or self.t[k].kind == "line" and depth == 0 or x == "else":
                break
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]", "}"):
                if depth == 0:
                    break
                depth -= 1
            elif x == ":" and depth == 0:
                typed = True
            elif x == "," and depth == 0:
                typed = False
            elif self.is_name(k) and not typed and self.text(k + 1) not in ("::", "(") and not (x[:1].isupper() and self.text(k + 1) in ("(", "{", "::")):
                self.add(k, "definition")
                if self.language == "go" and self.text(k + 1) != ",":
                    typed = True
            k += 1
        return i + 1

    def name(self, i: int, before: str, after: int) -> None:
        spec, x = self.spec, self.text(after)
        body = self.stack[-1][1] if self.stack else ""
        first = self.text(i - 1) in ("\n", "{", "") or before in ("{", "}", ";")
        lang = self.language
        if body == "enum" and before in ("{", ",") and x in (",", "}", "=", "(", "{", ";") or lang == "rust" and body == "struct" and x == ":" and before in ("{", ",", "pub", ")"):
            self.add(i, "definition")
            return
        if lang == "go":
            if body in ("struct", "interface") and self.text(i - 1) in ("\n", "{") and self.stack[-1][0]:
                self.add(i, "definition")
                if body == "interface" and x == "(":
                    end = self.parameters(after, self.text(i))
                    if self.text(self.solid(end, 1)) == "(" and self.t[end + 1 : end + 2] and self.t[end + 1].kind != "line":
                        self.parameters(self.solid(end, 1), self.text(i))
                return
            k = i
            while self.is_name(k) and self.text(k + 1) == ",":
                k += 2
            if self.text(k + 1) == ":=" and self.is_name(k) and before != ".":
                self.add(i, "definition")
                return
        if lang == "nix":
            k = i
            while self.text(k + 1) == "." and self.is_name(k + 2):
                k += 2
            if self.text(self.solid(k, 1)) == "=" and k == i and self.text(self.solid(i, 1)) == "=" or self.text(i + 1) == ":":
                self.add(i, "definition")
                if self.text(i + 1) != ":" and self.text(self.solid(self.solid(i, 1), 1)) in ("{", "rec"):
                    self.opens(i, self.text(i), "set")
                return
        if lang in ("js", "ts", "swift") and body in ("class", "interface") and x == "(" and before != ".":
            self.add(i, "definition")
            self.opens(i, self.text(i), "function")
            self.parameters(after, self.text(i))
            return
        if lang in ("js", "ts") and (body in ("class", "interface") and first and x in ("=", ":", ";", "?") or x == ":" and before in ("{", ",") and lang == "js"):
            self.add(i, "definition")
            return
        if spec.assigns and x == "=" and before not in (".", "->") and (lang != "php" or before == "$"):
            self.add(i, "definition")
            return
        if lang == "php" and body in ("class", "trait") and before == "$":
            self.add(i, "definition")
            return
        if spec.typed and self.declared(i, before, after, x, body):
            return
        self.add(i, "reference")

    def declared(self, i: int, before: str, after: int, x: str, body: str) -> bool:
        words = TYPE_WORDS.get(self.language, frozenset())
        p, pointer = self.solid(i, -1), False
        while self.text(p) in ("*", "&", "]", "[", ">") and p > 0:
            pointer = pointer or self.text(p) in ("*", "&")
            p = self.solid(p, -1)
        if pointer:  # a product or a mask, but where a statement begins
            q = self.solid(p, -1)
            if self.language in ("java", "glsl") or self.text(q) not in ("{", "}", ";", "", *DECLARING):
                return False
        typed = p >= 0 and self.t[p].kind == "name" and (self.text(p) in words or self.is_name(p)) and before not in (".", "->", "::")
        maker = self.language in ("java", "cpp") and bool(self.stack) and self.text(i) == self.stack[-1][0] and x == "("
        if not typed and not maker:
            return False
        if x == "(":
            end = self.close(after)
            k = self.solid(end, 1)
            while self.t[k : k + 1] and (self.t[k].kind == "name" or self.text(k) in (",", ".")) and self.text(k) in (",", ".", "const", "override", "noexcept", "final", "throws", "volatile") or self.is_name(k) and self.text(self.solid(k, -1)) in ("throws", ","):
                k = self.solid(k, 1)
            if self.text(k) in ("{", ":"):
                self.add(i, "definition")
                self.opens(i, self.text(i), "function")
                self.parameters(after, self.text(i))
                return True
            if self.text(k) == ";" and body in ("", "class", "struct", "namespace", "interface"):
                self.add(i, "declaration" if self.spec.declares else "definition")
                self.parameters(after, self.text(i))
                return True
            return False
        if x in ("=", ";", ",", "[", ":", ")", "{") and typed:
            self.add(i, "definition")
            return True
        return False

    def objc_at(self, i: int) -> int:
        word, k = self.text(i + 1), i + 2
        if word in ("interface", "implementation", "protocol") and self.is_name(k):
            if self.stack and self.stack[-1][1] == "objc":
                self.stack.pop()
            self.add(k, "definition")
            self.stack.append((self.text(k), "objc"))
            return k + 1
        if word == "end":
            while self.stack and self.stack.pop()[1] != "objc":
                pass
            return k
        if word == "property":
            names = []
            if self.text(k) == "(":
                k = self.close(k) + 1
            while k < len(self.t) and self.text(k) != ";":
                if self.is_name(k):
                    names.append(k)
                k += 1
            for x in names[:-1]:
                self.add(x, "reference")
            for x in names[-1:]:
                self.add(x, "definition")
            return k
        return i + 1

    def objc_method(self, i: int) -> int:
        k = self.solid(self.close(self.solid(i, 1)), 1)
        if not self.is_name(k):
            return i + 1
        name = self.text(k)
        self.add(k, "definition")
        self.opens(k, name, "function")
        while k < len(self.t) and self.text(k) not in ("{", ";"):
            if self.text(k) == ":" and self.text(k + 1) == "(":
                k = self.close(k + 1) + 1
                if self.is_name(k):
                    self.add(k, "definition", name)
            elif self.is_name(k):
                self.defined.add(k)
            k += 1
        return k


def _python(tokens: list[Token], hint: str | None) -> list[Reference]:
    """Scopes by indentation; a target before =, for, as and an import's alias are definitions."""
    words = _w("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield True False None match case _ self cls") - _w("self cls match case")
    found: list[Reference] = []
    stack: list[tuple[int, str]] = []
    rows: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:  # logical lines
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        if t.kind == "line" and depth <= 0:
            rows.append([])
            depth = 0
        elif t.kind != "line":
            rows[-1].append(t)
    for row in filter(None, rows):
        while stack and row[0].column <= stack[-1][0]:
            stack.pop()
        namespace = "::".join([*([hint] if hint else []), *(n for _, n in stack)]) or None
        defined: set[int] = set()
        head = [t.text for t in row]
        at = 1 if head[0] == "async" else 0
        opened = None
        if at < len(head) and head[at] in ("class", "def") and at + 1 < len(row) and row[at + 1].kind == "name":
            defined.add(at + 1)
            opened = (row[0].column, head[at + 1])

        def targets(part: range, row: list[Token] = row, head: list[str] = head, defined: set[int] = defined) -> None:
            inner = 0
            for k in part:
                inner += (head[k] == "[" and k > 0 and row[k - 1].kind == "name") - (head[k] == "]" and inner > 0)
                if row[k].kind == "name" and head[k] not in words and not inner and head[k - 1 : k] != ["."] and head[k + 1 : k + 2] not in (["."], ["("], ["["]):
                    defined.add(k)

        depth, start = 0, 0
        for k, x in enumerate(head):
            depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            if depth == 0 and x in ("=", "+=", "-=", "*=", "/=") and not defined & {1, 2} or depth == 0 and x == "=" and opened is None and start:
                colon = head.index(":", start, k) if ":" in head[start:k] else k
                targets(range(start, colon))
                start = k + 1
            elif x == "for":
                stop = next((j for j in range(k, len(head)) if head[j] == "in"), k)
                targets(range(k + 1, stop))
            elif x == "as" and k + 1 < len(head):
                if head[k + 1] == "(":
                    targets(range(k + 1, next((j for j in range(k, len(head)) if head[j] == ")"), len(head))))
                elif row[k + 1].kind == "name":
                    defined.add(k + 1)
        for k, t in enumerate(row):
            if t.kind == "name" and t.text not in words:
                inside = namespace if k in defined or opened is None or k <= at else "::".join(filter(None, [namespace, opened[1]]))
                found.append(Reference(t.text, "definition" if k in defined else "reference", inside, t.line, t.column))
        if opened:
            stack.append(opened)
    return found


def _lua(tokens: list[Token], hint: str | None) -> list[Reference]:
    """Blocks end with words; definitions have kinds of their own."""
    words = _w("and break do else elseif end false for function goto if in local nil not or repeat return then true until while")
    found: list[Reference] = []
    stack: list[str | None] = []
    done: set[int] = set()
    t = [x for x in tokens if x.kind != "line"]
    text = lambda i: t[i].text if 0 <= i < len(t) else ""
    named = lambda i: 0 <= i < len(t) and t[i].kind == "name" and text(i) not in words
    tables = 0

    def add(i: int, kind: str, *more: str) -> None:
        if i not in done:
            done.add(i)
            parts = [*([hint] if hint else []), *(s for s in stack if s), *more]
            found.append(Reference(text(i), kind, ":".join(parts) or None, t[i].line, t[i].column))

    i = 0
    while i < len(t):
        x = text(i)
        if x == "function":
            k, path = i + 1, []
            while named(k) or text(k) in (".", ":"):
                if named(k):
                    path.append(k)
                k += 1
            for p in path[:-1]:
                add(p, "reference")
            owner = [text(p) for p in path[:-1]]
            for p in path[-1:]:
                add(p, "function_definition", *owner)
            name = ":".join(text(p) for p in path) or None
            if text(k) == "(":
                k += 1
                while k < len(t) and text(k) != ")":
                    if named(k):
                        add(k, "parameter_definition", *([name] if name else []))
                    k += 1
            stack.append(name)
            i = k
        elif x in ("do", "then", "repeat"):
            stack.append(None)
        elif x in ("end", "until", "elseif", "else"):
            if stack:
                stack.pop()
            if x == "else":
                stack.append(None)
        elif x == "for":
            k = i + 1
            while named(k) or text(k) == ",":
                if named(k):
                    add(k, "loop_variable_definition")
                k += 1
        elif x == "local" and text(i + 1) != "function":
            k = i + 1
            while named(k) or text(k) == ",":
                if named(k):
                    add(k, "variable_definition")
                k += 1
        elif x in "{}":
            tables += 1 if x == "{" else -1
        elif named(i):
            if text(i + 1) == "=":
                add(i, "table_field_definition" if tables > 0 or text(i - 1) == "." else "variable_definition")
            else:
                add(i, "reference")
        i += 1
    return found


def references(source: str, language: str | None, hint: str | None = None) -> list[Reference]:
    """Names of a source; none for a language without rules. hint: the namespace around the whole file."""
    language = ALIASES.get(language or "", language or "")
    if language == "python":
        return _python(lex(source, language), hint)
    if language == "lua":
        return _lua(lex(source, language), hint)
    if language not in SPECS:
        return []
    return _Walk(lex(source, language), SPECS[language], language, hint).run()


LANGUAGES = frozenset({*SPECS, "python", "lua"})
#: Short sources that a task of extract() should have at most: a few seconds of work.
SOURCES_A_TASK = 10_000
SCHEMA = "content_hash string, name string, kind string, namespace string, line int, column int"


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many parts as SOURCES_A_TASK asks for. A small file that many sources are made from is one task else."""
    return rows.repartition(max(1, -(-rows.count() // SOURCES_A_TASK)))


def extract(blobs: DataFrame) -> DataFrame:
    """SCHEMA rows of blobs(content_hash, language, namespace, text). A name without a namespace of its own has the blob's.
    Null texts and languages without rules have no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, language, namespace, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in references(text, language) if text else ():
                    rows.append((key, r.name, r.kind, r.namespace or namespace, r.line, r.column))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int32()] * 2, strict=True)], ["content_hash", "name", "kind", "namespace", "line", "column"])

    return blobs.select("content_hash", "language", "namespace", "text").mapInArrow(run, SCHEMA)
