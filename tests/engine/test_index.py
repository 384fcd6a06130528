"""Operators on the index by hand: expected rows were worked out on paper."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import columns as C
from lumenseek.index import Index
from lumenseek.operators import content, facets, paths, retention, search, symbols, upkeep
from lumenseek.plans.language import request
from lumenseek.sources import ingest as wire
from lumenseek.streaming import ingest

from .index import NOW, hand_made


@pytest.fixture(scope="module")
def ix(spark):
    return hand_made(spark)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_terms_have_to_be_in_one_chunk(ix):
    assert rows(search.matches(ix, request("alpha historical:yes")), "file_id", "chunk_index") == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert rows(search.matches(ix, request("alpha beta historical:yes")), "file_id") == [(1,)]
    assert rows(search.matches(ix, request("alpha -beta historical:yes")), "file_id") == [(2,), (3,), (4,)]


def test_live_files_and_bare_repositories(ix):
    # core is live at main's head and snapshots; web has branches but no live one; bare is not known
    assert rows(search.live_only(ix, ix.files), "file_id") == [(3,), (6,)]


def test_excluding_a_language_drops_unknown_ones(ix):
    assert rows(search.matches(ix, request("alpha -lang:go historical:yes")), "file_id") == [(2,), (3,), (4,)]


def test_branch_filter_takes_names_and_commits(ix):
    assert rows(search.matches(ix, request("alpha branch:old")), "file_id") == [(1,), (2,)]
    assert rows(search.matches(ix, request("alpha branch:d1")), "file_id") == [(4,)]


def test_alternatives_count_twice_and_case_doubles(ix):
    both = search.score_files(search.matches(ix, request("(alpha or fn\\ alpha or alp) historical:yes")))
    assert {r.file_id: r.score for r in both.collect()}[2] >= 2
    exact = search.score_files(search.matches(ix, request("Alpha case:yes historical:yes")))
    assert rows(exact, "file_id", "score") == [(1, 2)]


def test_ranks(ix):
    page = search.search(ix, request("alpha historical:yes")).collect()
    assert [r.position for r in page] == list(range(1, len(page) + 1))
    # exact definitions of alpha in h2 come first; then a prefix in h3
    assert [r.file_id for r in page] == [2, 4, 3, 1]
    assert (page[0].definition_matches, page[0].total_score) == (2, 51.0)
    capped = search.search(ix, request("alpha historical:yes"), capped=True).collect()
    assert [r.file_id for r in capped] == [2, 4, 3, 1]


def test_facets(ix):
    found = search.ranked(ix, request("alpha historical:yes"))
    assert rows(facets.directories(found), "value", "count") == [("/*", 1), ("app/*", 1), ("src/*", 2)]
    assert rows(facets.file_types(found), "value", "count") == [("md", 1), ("py", 1), ("rs", 2)]


def test_contents(ix):
    text = {(r.repository, r.file_path, r.commit_sha): r.text for r in content.file_contents(ix).collect()}
    assert text["core", "src/my_file.rs", "c1"] == "fn alpha() {\n  beta();\n}\n"
    assert text["bare", "a.bin", "e1"] is None
    assert rows(content.chunk_start_lines(ix).filter("content_hash = 'h2'"), "chunk_index", "start_line") == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(ValueError):
        content.sliced(ix, ix.files, 3, 1)


def test_paths(ix):
    web = ix.files.filter("repository = 'web'")
    assert rows(paths.tree(web, "app"), "kind", "name") == [("dir", "deep"), ("file", "100%.py")]
    assert rows(paths.listed(web, "app", 2), "kind", "path") == [("dir", "app/deep"), ("dir", "app/deep/er"), ("file", "app/100%.py")]
    assert rows(paths.search_paths(ix.files, "DEEP"), "kind", "path") == [("dir", "app/deep"), ("dir", "app/deep/er"), ("file", "app/deep/er/x.py")]
    assert rows(paths.repository_counts(ix), "repository", "file_count") == [("core", 1)]
    assert ("bare", "e1", "e1", None, False) in rows(paths.repository_branches(ix), "repository", "branch", "commit_sha", "indexed_at", "is_live")


def test_globs_are_whole_paths_with_literal_like_signs(ix):
    assert rows(search.matches(ix, request("alpha file:APP/100%.py historical:yes")), "file_id") == [(4,)]
    assert rows(search.matches(ix, request("alpha file:*my?file* historical:yes")), "file_id") == [(2,), (3,)]
    assert rows(search.matches(ix, request("alpha file:my_file.rs historical:yes")), "file_id") == []


def test_symbols(ix):
    best = symbols.search_symbols(ix, symbols.SymbolRequest(name="alpha", repository="core", limit=None)).collect()
    assert [(r.kind, r.line_number, r.score) for r in best] == [("definition", 1, 200 + 40 + 35 + 70.0)]
    prefixed = symbols.SymbolRequest(namespace_prefix="core", kinds=("definition",))
    assert rows(symbols.search_symbols(ix, prefixed), "symbol") == [("alphabet",)]
    # a null kind counts as a definition
    assert ("beta", "definition") in rows(symbols.search_symbols(ix, symbols.SymbolRequest(name="beta")), "symbol", "kind")


def test_keep_set(ix):
    keep = {(r.repository, r.branch, r.commit_sha): r.keep for r in retention.keep_set(ix, NOW).collect()}
    core = {s for (_, b, s), k in keep.items() if k and _ == "core" and b == "main"}
    # newest: s6 (from the future, so day 0 and week 0 too); day 1: c2; day 3: s2; week 1: none; s5 is too old
    assert core == {"s6", "c2", "s2"}
    assert keep["core", "old", "s4"] and keep["web", "main", "d1"] and not keep["web", "main", "w0"]


def test_gc_and_prunes(ix):
    after, counts = retention.run_gc(ix, NOW)
    assert counts.first().snapshots_removed == 5
    assert rows(after.files, "file_id") == rows(ix.files, "file_id")
    left = retention.prune_commits(ix, ix.files.filter("repository = 'core'"))
    assert rows(left.blobs, "hash") == [("h2",), ("h4",), ("h5",)]
    assert rows(left.chunks, "chunk_hash") == [("k2",), ("k3",), ("k4",)]
    assert rows(left.symbols, "symbol_id") == [(1,), (2,), (4,)]
    with pytest.raises(ValueError):
        retention.prune_commit(ix, "core", "c2")
    assert rows(retention.prune_branch(ix, "core", "old").files.filter("repository = 'core'"), "file_id") == [(3,)]
    assert rows(retention.manual_retention(ix, False, 1).filter("keep"), "repository", "commit_sha") == [("bare", "e1"), ("core", "c2"), ("web", "d1")]


def test_symbol_cache(ix):
    cache = retention.unique_symbols(ix).filter("name_lc <> 'beta'")
    stale = cache.union(cache.limit(1).select(F.lit("gone")))
    assert rows(retention.refresh_symbols(cache, ix), "name_lc") == rows(retention.unique_symbols(ix), "name_lc")
    assert rows(retention.cleanup_symbols(stale, ix), "name_lc") == rows(cache, "name_lc")


def test_policies(spark, ix):
    spec = "repository string, branch string, latest_keep_count int, specs array<struct<interval_seconds:bigint,keep_count:int>>, live boolean"
    ask = spark.createDataFrame([("core", "dev", None, [(60, 2), (60, 5)], True), ("core", "main", 7, None, False)], spec)
    policies, specs, live = upkeep.upsert_policy(ix.policies, ix.snapshot_policies, ix.live, ask)
    assert rows(policies, "branch", "latest_keep_count") == [("dev", 1), ("main", 0), ("main", 7), ("old", 3)]
    assert rows(specs, "branch", "interval_seconds", "keep_count") == [("dev", 60, 2), ("main", 86400, 4), ("main", 604800, 2)]
    assert rows(live, "repository", "branch") == [("core", "dev")]
    with pytest.raises(ValueError):
        upkeep.upsert_policy(ix.policies, ix.snapshot_policies, ix.live, spark.createDataFrame([("a", "b", 0, None, None)], spec))


def test_branches_by_name_and_glob(ix):
    assert rows(upkeep.select_branches(ix.branches.select("branch"), ["main"], ["o*"]), "branch") == [("main",), ("old",)]
    with pytest.raises(ValueError):
        upkeep.select_branches(ix.branches.select("branch"), [], ["z*"])


def test_written_and_read(spark, ix, tmp_path):
    ix.write(str(tmp_path / "ix"))
    again = Index.read(spark, str(tmp_path / "ix"))
    assert rows(again.files, "file_id", "repository") == rows(ix.files, "file_id", "repository")
    assert "PartitionFilters: [isnotnull(repository" in again.files.filter("repository = 'web'")._jdf.queryExecution().toString()


def test_scalars(spark):
    df = spark.createDataFrame([("a\nb\n", "src/x/mod.rs"), ("", "lib.rs"), ("a", "a.b/c")], "t string, p string")
    got = df.select(C.line_count(F.col("t")), C.namespace_from_path(F.col("p"), True), C.extension_facet(F.col("p")), C.infer_language(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(2, "x", "rs", "rust"), (0, "crate", "rs", "rust"), (1, "a.b::c", "b/c", None)]
    pair = spark.createDataFrame([("src/db/mod.rs", "src/db/")], "a string, b string")
    assert pair.select(C.similarity(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_walk(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", ".hidden/b.txt": b"h\xc3\xa9", "target/c.rs": b"no", "d.bin": b"\x00\x01", "e.log": b"no", "bad.txt": b"\xff\xfe"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = wire.blobs_of(wire.walk(spark, str(tmp_path), ["*.log"]))
    assert rows(found.withColumn("text", F.coalesce("text", F.lit("-"))), "path", "line_count", "text") == [(".hidden/b.txt", 1, "hé"), ("a.py", 1, "x = 1\n"), ("bad.txt", 0, "-"), ("d.bin", 0, "-")]


def test_uploads(spark):
    parts = [("ok", 1, 2, b"cd"), ("ok", 0, 2, b"ab"), ("gap", 0, 2, b"x"), ("gap", 2, 2, b"y"), ("short", 0, 3, b"x")]
    got = {r.upload_id: (r.data and bytes(r.data), r.error is None) for r in wire.reassemble_uploads(spark.createDataFrame(parts, "upload_id string, chunk_index int, total_chunks int, data binary")).collect()}
    assert got == {"ok": (b"abcd", True), "gap": (None, False), "short": (None, False)}


def test_stream_adds_what_is_new(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "ix")
    (tmp_path / "in").mkdir()

    def send(*records):
        spark.createDataFrame(records, ingest.RECORD).coalesce(1).write.mode("append").parquet(source)

    def counts():
        return {t: spark.read.parquet(f"{index}/{t}").count() for t in ingest.KEYS}

    stream = spark.readStream.schema(ingest.RECORD).parquet(source)
    send(("r", "c1", "a.py", "one\n"), ("r", "c1", "b.py", "one\n"), ("r", "c1", "empty", ""), ("r", "c1", "bin", None))
    ingest.ingest(stream, index, str(tmp_path / "cp"))
    assert counts() == {"files": 3, "blobs": 2, "mapping": 1, "chunks": 1}
    send(("r", "c2", "a.py", "two\n"), ("r", "c1", "a.py", "one\n"))
    ingest.ingest(stream, index, str(tmp_path / "cp"))
    assert counts() == {"files": 4, "blobs": 3, "mapping": 2, "chunks": 2}
    ingest.ingest(stream, index, str(tmp_path / "cp-2"))  # all of it once more
    assert counts() == {"files": 4, "blobs": 3, "mapping": 2, "chunks": 2}


def test_poll_skips_heads_that_did_not_move(spark, tmp_path):
    source, seen = str(tmp_path / "heads"), []
    (tmp_path / "heads").mkdir()
    stream = spark.readStream.schema(ingest.HEAD).parquet(source)
    for heads in ([("r", "main", "c1"), ("r", "dev", "d1")], [("r", "main", "c1"), ("r", "dev", "d2")]):
        spark.createDataFrame(heads, ingest.HEAD).coalesce(1).write.mode("append").parquet(source)
        ingest.poll(stream, str(tmp_path / "log"), str(tmp_path / "cp"), lambda moved: seen.append(rows(moved, "branch", "commit_sha")))
    assert seen == [[("dev", "d1"), ("main", "c1")], [("dev", "d2")]]


def test_batches(spark, ix):
    hits = spark.createDataFrame([(1, 0, "r", "p", 3), (0, 5, "r", "p", 3), (0, 6, "r", "p", 4)], "query_ord int, rank int, repository string, file_path string, line int")
    assert rows(upkeep.batch_dedup(hits, "repo_path_line"), "rank") == [(5,), (6,)]
    assert rows(upkeep.batch_dedup(hits, "repo_path"), "rank") == [(5,)]
    assert upkeep.batch_dedup(hits, "none").count() == 3
    assert replace(ix, files=ix.files.limit(0)).files.count() == 0
