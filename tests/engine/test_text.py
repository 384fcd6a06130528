"""Snippets, scopes, chunks and symbol extraction, in plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenseek.functions import chunking, extractors, scopes, snippets


def defs(source, language, hint=None):
    return {(r.name, r.namespace) for r in extractors.references(source, language, hint) if r.kind == "definition"}


def refs(source, language):
    return {(r.name, r.namespace) for r in extractors.references(source, language) if r.kind == "reference"}


def test_extract_spans_are_bytes():
    (s,) = snippets.extract("zero\néé cat Cat\nlast", "cat", 1)
    assert (s.start_line, s.end_line, s.match_line) == (1, 3, 2)
    assert [s.text.encode()[a:b] for a, b in s.spans] == [b"cat", b"Cat"]


def test_merge_joins_touching_snippets():
    text = "\n".join(f"line {i}" for i in range(1, 30)).replace("line 5\n", "hit 5\n").replace("line 9\n", "hit 9\n").replace("line 25\n", "hit 25\n")
    merged = snippets.merge(snippets.extract(text, "hit", 2))
    assert [(s.start_line, s.end_line) for s in merged] == [(3, 11), (23, 27)]
    assert [s.text.encode()[a:b] for s in merged for a, b in s.spans] == [b"hit"] * 3


def test_rank_prefers_definitions_then_coverage():
    plain = snippets.rank("aa bb", [(0, 2), (3, 5)], False, "aa|bb", False)
    many = snippets.rank("aa aa aa", [(0, 2), (3, 5), (6, 8)], False, "aa|bb", False)
    assert snippets.rank("aa", [(0, 2)], True, "aa|bb", False) > plain > many


def test_plain_terms():
    assert snippets.plain_terms(r"a\.b|c") == ["a.b", "c"]
    assert snippets.plain_terms(r"\d+") is None
    assert snippets.plain_terms("a||b") is None


def test_segments_stay_on_characters():
    assert snippets.segments("aéb", [(2, 4)]) == [("aé", False), ("b", True)]


def test_scopes():
    source = "package p\n\nfunc outer(a int) {\n\tif a > 1 {\n\t\tcall()\n\t}\n}\n"
    found = scopes.scopes_of(source, "go")
    assert [(s.label, s.start_line, s.end_line, s.depth) for s in found] == [("func outer(a int)", 3, 7, 0), ("if a > 1", 4, 6, 1)]
    assert scopes.chain_at(found, 5) == [("func outer(a int)", 3), ("if a > 1", 4)]
    found = scopes.scopes_of("class A:\n    def f(self):\n        pass\nx = 1\n", "python")
    assert [(s.label, s.start_line, s.end_line, s.parent) for s in found] == [("class A", 1, 3, None), ("def f(self)", 2, 3, 0)]


@pytest.mark.parametrize("n", [0, 1, 70_000, 900_000, 3_000_000])
def test_chunks_cover_and_end_at_lines(n):
    rng = random.Random(n)
    data = b"".join(bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 90))) + b"\n" for _ in range(n // 45))[:n]
    ranges = chunking.chunk_ranges(data)
    assert b"".join(data[s:e] for s, e in ranges) == data
    assert all(data[e - 1 : e] == b"\n" for _, e in ranges[:-1])
    assert n < chunking.MIN or len(ranges) >= n // (chunking.MOST + 100)
    # a change at the front moves no far cut
    if n == 3_000_000:
        other = chunking.chunk_ranges(b"xx\n" + data)
        assert len({e - 3 for _, e in other} & {e for _, e in ranges}) >= len(ranges) // 2


def test_python_names():
    source = "class Box:\n    size = 1\n\n    async def put(self, item):\n        for a, b in item:\n            total = a\n        with open(b) as f:\n            pass\n\nimport os as system\n"
    assert defs(source, "python") == {("Box", None), ("size", "Box"), ("put", "Box"), ("a", "Box::put"), ("b", "Box::put"), ("total", "Box::put"), ("f", "Box::put"), ("system", None)}
    assert ("item", "Box::put") in refs(source, "python")
    assert ("Box", "pkg") in defs(source, "python", "pkg")


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("go", "package p\nconst top = 1\ntype T struct {\n\tF int\n}\nfunc (t *T) M(k int) int {\n\tv := k\n\treturn v\n}\n", {("p", None), ("top", "p"), ("T", "p"), ("F", "p.T"), ("M", "p.T"), ("t", "p.T.M"), ("k", "p.T.M"), ("v", "p.T.M")}),
        ("rust", "mod m { struct P { x: u32 } impl P { fn f(a: u32) -> u32 { let b = a; b } } enum E { A, B } }", {("m", None), ("P", "m"), ("x", "m::P"), ("f", "m::P"), ("a", "m::P::f"), ("b", "m::P::f"), ("E", "m"), ("A", "m::E"), ("B", "m::E")}),
        ("java", "package a.b; class W { int n = 0; int f(int d) { String s = g(d); return s; } enum M { X, Y } }", {("W", "a.b"), ("n", "a.b.W"), ("f", "a.b.W"), ("d", "a.b.W.f"), ("s", "a.b.W.f"), ("M", "a.b.W"), ("X", "a.b.W.M"), ("Y", "a.b.W.M")}),
        ("js", "class K { m(a) { const z = a; } }\nfunction f(x) { let {u, v} = x; }\n", {("K", None), ("m", "K"), ("a", "K.m"), ("z", "K.m"), ("f", None), ("x", "f"), ("u", "f"), ("v", "f")}),
        ("cpp", "namespace n { class W { int v; int get(int k) { return k; } }; }", {("n", None), ("W", "n"), ("v", "n::W"), ("get", "n::W"), ("k", "n::W::get")}),
        ("proto", "package x.y;\nmessage Msg { string name = 1; }\nservice S { rpc Call (Msg) returns (Msg); }", {("x", None), ("Msg", "x.y"), ("S", "x.y"), ("Call", "x.y.S")}),
        ("swift", "class C { var v = 1\n func f(a b: Int) { let c = b } }", {("C", None), ("v", "C"), ("f", "C"), ("b", "C.f"), ("c", "C.f")}),
        ("nix", "x: { a = 1; b = { c = x; }; }", {("x", None), ("a", None), ("b", None), ("c", "b")}),
        ("php", "<?php namespace N; class A { public $p; function f($q) { $r = $q; } }", {("A", "N"), ("p", "N\\A"), ("f", "N\\A"), ("q", "N\\A\\f"), ("r", "N\\A\\f")}),
    ],
)
def test_names(language, source, want):
    assert defs(source, language) == want


def test_prototypes_are_declarations_and_lua_has_kinds_of_its_own():
    assert {(r.name, r.kind) for r in extractors.references("int add(int a);", "c")} >= {("add", "declaration"), ("a", "definition")}
    kinds = {(r.name, r.kind) for r in extractors.references("local x = 1\nfunction f(a) for i = 1, 2 do end end\nt = { k = 1 }", "lua")}
    assert kinds == {("x", "variable_definition"), ("f", "function_definition"), ("a", "parameter_definition"), ("i", "loop_variable_definition"), ("t", "variable_definition"), ("k", "table_field_definition")}


def test_columns_are_bytes_and_strings_and_comments_are_left_out():
    found = extractors.references('é = "word" # note\nb = é', "python")
    assert [(r.name, r.line, r.column) for r in found] == [("é", 1, 1), ("b", 2, 1), ("é", 2, 5)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(extractors.LANGUAGES)), st.text(alphabet="abfn {}()[]<>;:=,.\n\"'/*-+@#$ \té", max_size=120))
def test_any_text_is_read(language, text):
    for r in extractors.references(text, language):
        assert r.name and r.line >= 1 and r.column >= 1


def test_names_and_brackets_are_read_without_trying_every_sign():
    class Counted(str):
        tried = 0

        def startswith(self, *args):
            Counted.tried += 1
            return super().startswith(*args)

    tokens = extractors.lex(Counted("foo(bar, [baz]);\n\tü²x == 'a' // b\n"), "ts")
    assert [(t.text, t.line, t.column) for t in tokens] == [
        ("foo", 1, 1), ("(", 1, 4), ("bar", 1, 5), (",", 1, 8), ("[", 1, 10), ("baz", 1, 11), ("]", 1, 14), (")", 1, 15), (";", 1, 16), ("\n", 1, 17),
        ("ü²x", 2, 2), ("==", 2, 8), ("\n", 2, 19),
    ]
    assert 0 < Counted.tried < 25
