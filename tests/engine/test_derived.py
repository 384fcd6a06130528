"""Queries over small tables of odd documents against their SQL."""

from dataclasses import replace
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenseek.catalog import ORACLES, QUERIES
from lumenseek.functions.extractors import extract
from lumenseek.operators import search, upkeep
from lumenseek.plans.language import request
from lumenseek.sources import corpus
from lumenseek.streaming import ingest

from .test_catalog import norm

#: Neighbouring lines with a term, lines that repeat, copies of a text in two languages.
TEXTS = [
    ("en", "a thonin of it\na thonin of it\na thonin of it\nthonin and thonin\nno more\n"),
    ("en", "none\nthonin one\nThonin two, thonin\nnone"),
    ("de", "none\nthonin one\nThonin two, thonin\nnone"),
    ("fr", "\n".join(["x thonin", "y", "x thonin", "y", "y", "x thonin", "y"] * 9)),
    ("en", "ontion the and ontion\nontion (ontion) thonin\n"),
    ("es", "\n".join(["all thonin alike"] * 12 + ["other"])),
    ("fr", ""),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, text, lang, f"src{k % 4}", len(text)) for k, (lang, text) in enumerate(TEXTS)]
    events = [(k, datetime(2024, 1, 1 + k), k, ("view", "purchase")[k % 2], 1.0, "{}") for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def compare(spark, tables, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    want = sorted([norm(r[names.index(c)]) for c in columns] for r in answer.fetchall())
    assert want
    assert sorted([norm(r[c]) for c in columns] for r in df.collect()) == want


@pytest.mark.parametrize("name", ["snippet_spans", "snippet_merge"])
def test_lines_that_repeat(spark, tables, name):
    compare(spark, tables, name)


@pytest.mark.parametrize("name", ["search_plain", "symbol_insights", "attach_references", "file_views", "blob_line_counts", "search_page_with_snippets"])
def test_copies_of_a_text_count_once(spark, tables, name):
    compare(spark, tables, name)


def test_references_are_attached_inside_their_texts(spark, tables):
    """No word is shuffled, and references of unknown names and namespaces go as they do by joins."""
    plan = QUERIES["attach_references"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "Exchange hashpartitioning(content_hash" not in plan
    words = [("a", 1, 1, "definition"), ("a", 1, 2, "reference"), ("b", 2, 1, "definition"), ("c", 2, 2, "definition")]
    rows = [("h1", "n", ["a", "b"], words), ("h2", "n", ["c"], words), ("h3", "m", ["a", "c"], words), ("h4", "n", [], words), ("h5", "n", ["a"], [])]
    contents = spark.createDataFrame(rows, "content_hash string, namespace string, names array<string>, words array<struct<name string, line_number int, column_number int, kind string>>")
    namespaces = spark.createDataFrame([(1, "n"), (2, "k")], "namespace_id long, namespace string")
    symbols = contents.select("content_hash", F.explode("names").alias("name")).withColumn("symbol_id", F.xxhash64("content_hash", "name"))
    refs = contents.select("content_hash", "namespace", F.explode("words").alias("w")).select("content_hash", "namespace", "w.*")
    columns = ["symbol_id", "namespace_id", "kind", "line_number", "column_number"]
    found = upkeep.attach_within(contents, namespaces).withColumn("symbol_id", F.xxhash64("content_hash", "name")).select(columns).collect()
    assert len(found) == 4
    assert sorted(found) == sorted(upkeep.attach_references(refs, symbols, namespaces).select(columns).collect())


SEARCHES = ["search_or_counts_twice", "filter_historical", "filter_branch_excluded", "filter_lang", "facet_branches", "batch_dedup_none"]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_shuffle_no_text(spark, tables, name):
    """Chunks are tested at their places: neither they nor the list of places meet by a shuffle."""
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_hash" not in plan
    compare(spark, tables, name)


def test_contents_are_shuffled_once(spark, tables):
    plan = QUERIES["file_views"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_hash" not in plan
    compare(spark, tables, "snippet_needle")


@pytest.mark.parametrize("text", ["thonin", "thonin repo:src0", "(thonin or ontion) historical:yes", "ontion (lang:en or repo:src0)", '"the and" -branch:dev', "regex:th.nin -other"])
def test_places_give_what_their_join_gives(spark, tables, text):
    ix, r = corpus.stored(spark, tables), request(text)
    rows = lambda ix: sorted(search.matches(ix, r).collect())
    assert rows(ix) == rows(replace(ix, places=None)) != []


def test_index_is_not_larger_than_its_texts(spark, tmp_path):
    """Only hashes of copied texts are stored."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2((F.col("id") % 2900 * 7 + k).cast("string"), 256) for k in range(9))).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, datetime(2024, 1, 1), 1, "view", 1.0, "{}")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    used = lambda at: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = used(shared)
    ix = corpus.stored(spark, str(tmp_path))
    assert ix.references.count() > ix.symbols.count() > 2900
    assert ix.blobs.count() == 2900
    assert used(shared) - before < used(tmp_path / "documents.parquet") / 4


@pytest.mark.parametrize("name", ["extracted_objc", "extracted_symbols", "scope_chain"])
def test_sources_made_from_one_file_are_several_tasks(spark, tmp_path, name):
    spark.range(25_001).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    assert df.select(df.columns[0]).distinct().count() == 25_001


def test_names_are_extracted_once_and_apart(spark, tmp_path, monkeypatch):
    """Texts come to extract() in parts bounded by bytes, a single time for three tables."""
    seen = []
    monkeypatch.setattr(ingest, "EXTRACTED_A_TASK", 1 << 10, raising=False)
    monkeypatch.setattr(ingest, "extract", lambda blobs: seen.append(blobs.rdd.getNumPartitions()) or extract(blobs))
    records = [("r", "c", f"{k}.py", f"def f{k}(x):\n    return x\n" * 20) for k in range(20)]
    ingest.ingest_batch(spark.createDataFrame(records, ingest.RECORD), str(tmp_path))
    assert len(seen) == 1 and seen[0] > 4
    assert spark.read.parquet(f"{tmp_path}/symbols").filter("name_lc = 'f7'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 20
