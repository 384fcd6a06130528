"""Inserts and upserts as DataFrames: what is new, and what a table becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row for each key, the first of an order."""
    w = Window.partitionBy(keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def missing(wanted: DataFrame, known: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """Keys that known lacks; without distinct, repetitions stay."""
    rows = wanted.select(key).join(known.select(key).distinct(), key, "left_anti")
    return rows.distinct() if distinct else rows


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The table with rows whose keys it lacks; of rows with the same key the first of an order."""
    new = first_by(rows, keys, *(order or [F.xxhash64(*rows.columns)]))
    return table.unionByName(new.join(table.select(keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The table with rows in place of those of the same keys. The side with the new rows is small; the table is only
    filtered, which keeps its partitioning."""
    new = first_by(rows, keys, *order)
    return table.join(new.select(keys), keys, "left_anti").unionByName(new.select(table.columns))


def attach_references(refs: DataFrame, symbols: DataFrame, namespaces: DataFrame) -> DataFrame:
    """References by (content_hash, name, namespace) as ids; those without such a symbol or namespace are dropped."""
    return refs.join(symbols, ["content_hash", "name"]).join(namespaces, "namespace").select("symbol_id", "namespace_id", "kind", "line_number", "column_number").distinct()


#: Up to so many namespaces are sent to every task.
NAMESPACES_SENT = 10_000


def attach_within(contents: DataFrame, namespaces: DataFrame) -> DataFrame:
    """attach_references where all of a content lies in one row: contents(content_hash, namespace, names, words), each content
    once, its words without repetitions. They meet their symbols inside the row, so that no reference is shuffled; as a
    symbol's id is made of its content and name, these stand for it."""
    few = namespaces.limit(NAMESPACES_SENT + 1).count() <= NAMESPACES_SENT
    rows = contents.join(F.broadcast(namespaces) if few else namespaces, "namespace")
    rows = rows.select("content_hash", "namespace", "namespace_id", "words", F.array_except("words.name", "names").alias("unknown"))
    # used twice, unknown stays a column of its own: a lambda would compute it again for each word
    own = F.when(F.size("unknown") == 0, F.col("words")).otherwise(F.filter("words", lambda w: ~F.array_contains("unknown", w["name"])))
    return rows.select("content_hash", "namespace", "namespace_id", F.explode(own).alias("w")).select("content_hash", "w.name", "namespace", "namespace_id", "w.kind", "w.line_number", "w.column_number")


def upsert_policy(policies: DataFrame, snapshot_policies: DataFrame, live: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policies after requests(repository, branch, latest_keep_count?, specs array<struct<interval_seconds, keep_count>>?,
    live boolean?). No count: 1. Given specs replace all of the branch's; of an interval given twice the first counts. live
    true makes the branch its repository's live one, false ends that, null leaves it. Counts and intervals under 1 raise."""
    bad = requests.filter("latest_keep_count < 1 or exists(specs, s -> s.interval_seconds < 1 or s.keep_count < 1)")
    if not bad.isEmpty():
        raise ValueError("keep counts and intervals have to be positive")
    key = ["repository", "branch"]
    new = requests.select(*key, F.coalesce("latest_keep_count", F.lit(1)).cast("int").alias("latest_keep_count"))
    specs = requests.filter("specs is not null").select(*key, F.posexplode("specs").alias("k", "s"))
    specs = first_by(specs.select(*key, "s.interval_seconds", "s.keep_count", "k"), [*key, "interval_seconds"], "k").drop("k")
    kept = snapshot_policies.join(requests.filter("specs is not null").select(key), key, "left_anti")
    on = requests.filter("live").select(*key, F.lit(None).cast("timestamp").alias("updated_at"))
    stays = live.join(on.select("repository"), "repository", "left_anti").join(requests.filter("not live").select(key), key, "left_anti")
    return upsert(policies, new, key, "latest_keep_count"), kept.unionByName(specs.select(kept.columns)), stays.select(live.columns).unionByName(on.select(live.columns))


def append_snapshots(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """Snapshots with the new heads; the time of one that is there stays."""
    return insert_ignore(snapshots, heads.select(snapshots.columns), ["repository", "branch", "commit_sha"], "indexed_at")


def select_branches(heads: DataFrame, exact: list[str], globs: list[str]) -> DataFrame:
    """Branches that are named, or match a glob, in order; none is an error."""
    tests = [F.col("branch").isin(*exact)] if exact else []
    for g in globs:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in g.replace("**", "\0")).replace("\\\0", ".*")
        tests.append(F.col("branch").rlike(f"^{pattern}$"))
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    out = heads.filter(hit).distinct().orderBy("branch")
    if out.isEmpty():
        raise ValueError("no branch matches")
    return out


def batch_dedup(rows: DataFrame, mode: str) -> DataFrame:
    """Results of several queries without repetitions: by repo_path_line, repo_path or none; the first stays, in the order
    of queries (query_ord) and ranks (rank)."""
    keys = {"repo_path_line": ["repository", "file_path", "line"], "repo_path": ["repository", "file_path"], "none": None}[mode]
    return rows if keys is None else first_by(rows, keys, "query_ord", "rank", "line")


def byte_budget(rows: DataFrame, most: int, *order: str | Column) -> DataFrame:
    """The longest prefix of an order whose JSON array has at most so many bytes."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # one response's rows
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(w) - 1 + 2
    return rows.withColumn("_bytes", total).filter(F.col("_bytes") <= most).drop("_bytes")
