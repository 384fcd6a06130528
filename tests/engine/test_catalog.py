"""Queries against the SQL that another engine runs on the same tables. CATALOG_ALL=1: all of them."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from lumenseek.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = "search_plain search_grouped_dnf search_page_1 filter_branch facet_directories left_live_filter theta_symbol_like chunk_start_lines file_line_slice file_list_depth_2 path_search_top_50 autocomplete_symbols symbol_search_ranked trigram_similarity namespace_from_path gc_keep_set prune_branch_survivors upsert_latest_wins batch_dedup_repo_path byte_budget_prefix snippet_spans chunked_reassembly scope_chain extracted_symbols extracted_objc extracted_glsl snippet_merge symbol_insights repository_index stream_ingest_incremental".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, norm(x)) for k, x in v.items()))
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("CATALOG_ALL") else SOME)
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([norm(r[c]) for c in columns] for r in df.collect())
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted([norm(r[names.index(c)]) for c in columns] for r in answer.fetchall())


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
