"""Composed answers, the trigram index, and the way from a folder to an index."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import columns as C
from lumenseek.index import Index
from lumenseek.operators import content, paths, responses, search, symbols, textindex
from lumenseek.plans.language import request
from lumenseek.sources import ingest as wire
from lumenseek.streaming import ingest

from .index import NOW, hand_made


@pytest.fixture(scope="module")
def ix(spark):
    return hand_made(spark)


@pytest.fixture(scope="module")
def stored(spark, ix, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ix.write(path)
    return Index.read(spark, path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("text", ["alpha", "Alpha case:yes", "(alpha or gamma) historical:yes", "gamma -alpha historical:yes", "regex:al.ha", "(beta or regex:gam+a ) (lang:rust or repo:core ) historical:yes", "beta repo:core", "(alpha lang:rust ) or (beta branch:old )", '"gamma é" historical:yes'])
def test_trigrams_and_one_scan_change_nothing(ix, stored, text):
    r = request(text, strict=True)
    columns = ["file_id", "chunk_index", "highlight_pattern", "highlight_case_sensitive", "include_historical"]
    parts = [search.plan_matches(ix, p) for p in r.plans]
    want = sorted(x for p in parts for x in rows(p, *columns))
    assert rows(search.matches(ix, r), *columns) == rows(search.matches(stored, r), *columns) == want
    assert rows(search.ranked(ix, r), *search.RESULT) == rows(search.ranked(stored, r), *search.RESULT)


def test_grams(ix):
    assert textindex.grams_of("ab") == [] and len(textindex.grams_of("abcab")) == 3
    hit = textindex.candidates(textindex.postings(ix.chunks), list(request("GAMMA").plans))
    assert hit.count() == 1
    assert textindex.candidates(textindex.postings(ix.chunks), list(request("regex:ga.ma").plans)) is None
    assert textindex.required_grams(request("Éab case:yes").plans[0].required[0], True) == []


def test_page(ix):
    got = responses.page(ix, request("alpha")).collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    assert all(r.snippets and r.match_line == r.snippets[0].match_line and r.permalink.endswith(f"#L{r.match_line}") and r.open_at_line.path == r.file_path for r in got)


def test_insights(ix):
    got = responses.insights(ix, "core", "old", "alpha").collect()
    assert [(r.symbol, r.reference.kind, r.reference.line, r.start_line) for r in sorted(got, key=lambda r: r.reference.line)] == [("alpha", "definition", 1, 1), ("alpha", "reference", 2, 1)]
    assert got[0].reference.asDict().keys() == {"namespace", "name", "kind", "line", "column", "repository", "commit_sha", "file_path"}
    assert responses.insights(ix, "core", "old", "alpha", scope="directory", path="app/x.py").count() == 0
    assert responses.insights(ix, "core", "old", "alpha", scope="directory", path="src/x.rs").count() == 2
    assert responses.insights(ix, "core", "old", "alpha", scope="custom", include_paths=("src/",), excluded_paths=("src/my_file.rs",)).count() == 0
    with pytest.raises(ValueError):
        responses.insights(ix, "core", "old", " ")
    assert [responses.directory_prefix(p) for p in ("a/b/c.rs", "a/b/", "x", "/", "/a/x")] == ["a/b", "a/b", None, None, "a"]


def test_needles(spark):
    df = spark.createDataFrame([("one\nTwo words",), ("three",), (None,)], "s string")
    for needle, want in (("", [True] * 3), ("two", [True, False, False]), ("E", [True, True, False]), ("one\ntwo", [False] * 3)):
        assert [r[0] for r in df.select(responses.snippet_has(F.col("s"), needle)).collect()] == want


def test_views(spark, ix):
    entries, readme = responses.directory_view(ix, "core", "old")
    assert rows(entries, "kind", "name") == [("dir", "src"), ("file", "README.md")]
    assert readme.first().text == "Alpha\r\nbeta\n"
    assert responses.directory_view(ix, "web", "main", "app/")[1].count() == 0
    kinds = {r.file_path: (r.kind, r.line_count, r.download is None) for r in responses.file_view(ix, ix.files.filter("repository <> 'web'")).collect() if r.file_path != "src/my_file.rs"}
    assert kinds == {"README.md": ("file", 2, True), "a.bin": ("binary", None, False)}
    assert content.missing_files(ix, spark.createDataFrame([("core", "c1", "no"), ("core", "c1", "README.md")], "repository string, commit_sha string, file_path string")).count() == 1
    assert rows(content.readmes(ix), "file_path") == [("README.md",)]
    assert responses.healthy(spark, ix).first().ok


def test_batch(ix):
    b = responses.batch(ix, ["alpha", " beta ", ""], dedupe="repo_path", most=1)
    assert all(r["count"] <= 1 for r in b.counts.collect()) and b.counts.count() == 2
    assert b.deduped_count.first()[0] == b.results.count() <= 2
    assert b.freshness.columns == ["indexed_at"] and b.file_types.count() >= 1
    for bad in ({"any_terms": []}, {"any_terms": ["abc"] * 9}, {"any_terms": ["abc"], "dedupe": "all"}):
        with pytest.raises(ValueError):
            responses.batch(ix, **bad)


def test_caps_of_interactive_tools(ix):
    some, cursor = paths.paged(ix.files, 0, 2, "file_id")
    assert rows(some, "file_id") == [(1,), (2,)] and cursor == 2
    assert paths.paged(ix.files, 0, 2, "file_id", pages=9)[1] is None
    assert paths.paged(ix.files, 0, 2, "file_id", pages=2, cap=3)[0].count() == 3
    assert rows(paths.prefetched_paths(ix.files, "APP", 2), "kind", "path") == [("dir", "app"), ("dir", "app/deep")]
    assert paths.listed_capped(ix.files, depth=5, source=2, entries=1).count() == 1
    r = request("alpha historical:yes")
    assert search.has_more(ix, r, capped=True).first().has_more is False
    assert search.has_more(ix, replace(r, page_size=0), capped=True).first().has_more is True


def test_symbol_by_position(ix):
    at = symbols.symbol_references(ix, "core", "c1", "alpha", position=("src/my_file.rs", 1, 4))
    assert rows(at, "kind", "line_number") == [("definition", 1), ("reference", 2)]
    assert symbols.symbol_references(ix, "core", "c1", "alpha", position=("src/my_file.rs", 9, 9)).count() == 0


def test_small_functions(spark):
    df = spark.createDataFrame([(" /a//b/c/ ", datetime(2024, 3, 1, 12))], "p string, t timestamp")
    assert tuple(df.select(C.normalized_path(F.col("p")), C.rfc3339(F.col("t"))).first()) == ("a/b/c", "2024-03-01T12:00:00.000000Z")


def test_folder_to_index(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {"src/lib.rs": b"pub fn area() -> u32 {\n    side()\n}\n", "tools/run.py": b"def run(x):\n    return x\n", "tools/.gitignore": b"*.log\n!keep.log\n", "tools/a.log": b"no", "tools/keep.log": b"yes yes", "b.log": b"other", "pic.bin": b"\0\1", ".hidden": b"text", "node_modules/x.js": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    path = str(tmp_path / "index")
    ix = ingest.index_repository(spark, str(root), "r", "main", "c1", path, NOW)
    assert rows(ix.files, "file_path") == [(p,) for p in sorted([".hidden", "b.log", "pic.bin", "src/lib.rs", "tools/.gitignore", "tools/keep.log", "tools/run.py"])]
    found = symbols.search_symbols(ix, symbols.SymbolRequest(kinds=("definition",), limit=None))
    assert {("area", "rust"), ("run", "python")} <= {(r.symbol, r.language) for r in found.collect()}
    assert rows(search.ranked(ix, request("yes")), "file_path") == [("tools/keep.log",)]
    assert rows(search.ranked(ix, request("area")), "file_path", "definition_matches") == [("src/lib.rs", 2)]
    before = {t: getattr(ix, t).count() for t in ("files", "blobs", "chunks", "mapping", "symbols", "references", "namespaces", "postings", "branches", "live", "snapshots")}
    again = ingest.index_repository(spark, str(root), "r", "main", "c1", path, NOW)
    assert {t: getattr(again, t).count() for t in before} == before
    (root / "src/lib.rs").write_bytes(b"pub fn volume() {}\n")
    later = ingest.index_repository(spark, str(root), "r", "main", "c2", path, NOW + timedelta(days=1))
    assert rows(later.branches, "commit_sha") == [("c2",)] and later.snapshots.count() == 2
    assert rows(search.ranked(later, request("volume")), "commit_sha") == [("c2",)]


def test_shards_and_spool(spark, tmp_path):
    df = spark.range(1000).select("id", F.repeat(F.lit("é x"), 10).alias("text")).coalesce(1)
    shards = wire.shards(df, "rows", records=300, most=8000)
    sizes = [(r.records, r.raw_bytes) for r in shards.collect()]
    assert sum(n for n, _ in sizes) == 1000 and all(n <= 300 and b <= 8000 for n, b in sizes)
    assert wire.records_of(shards, "rows", "id long, text string").exceptAll(df).count() == 0
    assert wire.shards(df.limit(1), "rows", most=1).first().records == 1
    spool = wire.Spool(spark, str(tmp_path / "spool"))
    for _ in range(2):
        spool.append("rows", df)
    assert spool.read("rows", "id long, text string").count() == 2000
    assert [t.num_rows for t in spool.batches("rows", "id long, text string", 600)] in ([600, 400] * 2, [600, 600, 600, 200])
    wire.write_report({"rows": df}, str(tmp_path / "report"), 400)
    assert spark.read.json(str(tmp_path / "report/rows")).count() == 1000


def test_due_and_sweeps(spark, tmp_path):
    log = str(tmp_path / "log")
    repos = spark.createDataFrame([("a", 60), ("b", 3600), ("bad", 60)], "repository string, interval_seconds long")
    ended = []

    def each(name):
        if name == "bad":
            raise RuntimeError(name)

    assert ingest.sweep(spark, repos, log, NOW, each, ended.append) == ["a", "b"]
    assert ingest.sweep(spark, repos, log, NOW + timedelta(seconds=90), each, ended.append) == ["a"]
    assert ended == [["a", "b"], ["a"]]
    assert ingest.repeatedly(spark, print, str(tmp_path / "c"), None) is None
