"""Which snapshots stay, what goes with a commit, and orphans. Every function gives the new tables; nothing is updated in
place, and a caller writes them to a new folder and swaps."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..index import Index

SNAPSHOT = ["repository", "branch", "commit_sha"]


def keep_set(ix: Index, now: datetime) -> DataFrame:
    """(repository, branch, commit_sha, keep) of branches with a policy: kept are the newest, at least one, and for each
    interval the newest of each age bucket under the policy's count. Snapshots from the future are in bucket 0."""
    at = F.lit(now)
    newest = Window.partitionBy("repository", "branch").orderBy(F.desc("indexed_at"), "commit_sha")
    rows = ix.snapshots.join(ix.policies, ["repository", "branch"]).withColumn("nth", F.row_number().over(newest))
    latest = rows.select(*SNAPSHOT, (F.col("nth") <= F.greatest("latest_keep_count", F.lit(1))).alias("keep"))
    elapsed = F.floor((F.unix_micros(at) - F.unix_micros(F.col("indexed_at").cast("timestamp"))) / 1e6)
    bucket = F.when(elapsed <= 0, 0).otherwise(F.floor(elapsed / F.col("interval_seconds")))
    specs = ix.snapshot_policies.filter("interval_seconds > 0 and keep_count > 0")
    aged = ix.snapshots.join(ix.policies.select("repository", "branch"), ["repository", "branch"], "left_semi").join(specs, ["repository", "branch"]).withColumn("bucket", bucket).filter("bucket < keep_count")
    first = Window.partitionBy("repository", "branch", "interval_seconds", "bucket").orderBy(F.desc("indexed_at"), "commit_sha")
    by_age = aged.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*SNAPSHOT, F.lit(True).alias("keep"))
    return latest.unionByName(by_age).groupBy(SNAPSHOT).agg(F.max("keep").alias("keep"))


def removals(ix: Index, now: datetime) -> DataFrame:
    return keep_set(ix, now).filter(~F.col("keep")).select(SNAPSHOT)


def protected_commits(ix: Index) -> DataFrame:
    """(repository, commit_sha) that a snapshot or a branch head names."""
    k = ["repository", "commit_sha"]
    return ix.snapshots.select(k).union(ix.branches.select(k)).distinct()


def prune_commits(ix: Index, commits: DataFrame) -> Index:
    """The index without the files of commits(repository, commit_sha), then without blobs that no file names, their
    symbols, references and chunk lists, then without chunks that no list names."""
    k = ["repository", "commit_sha"]
    return collect_orphans(replace(ix, files=ix.files.join(commits.select(k).distinct(), k, "left_anti")))


def orphan_blobs(ix: Index) -> DataFrame:
    return ix.blobs.join(ix.files.select(F.col("content_hash").alias("hash")).distinct(), "hash", "left_anti")


def orphan_chunks(ix: Index) -> DataFrame:
    return ix.chunks.join(ix.mapping.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def collect_orphans(ix: Index) -> Index:
    used = ix.files.select("content_hash").distinct()
    mapping = ix.mapping.join(used, "content_hash", "left_semi")
    symbols = ix.symbols.join(used, "content_hash", "left_semi")
    joined = None if ix.joined is None else ix.joined.join(used, "content_hash", "left_semi")
    return replace(
        ix,
        blobs=ix.blobs.join(used.withColumnRenamed("content_hash", "hash"), "hash", "left_semi"),
        mapping=mapping,
        chunks=ix.chunks.join(mapping.select("chunk_hash").distinct(), "chunk_hash", "left_semi"),
        symbols=symbols,
        references=ix.references.join(symbols.select("symbol_id"), "symbol_id", "left_semi") if joined is None else joined.select(ix.references.columns),
        joined=joined,
        contents=None if ix.contents is None else ix.contents.join(used, "content_hash", "left_semi"),
        places=None if ix.places is None else ix.places.join(used, "content_hash", "left_semi"),
    )


def run_gc(ix: Index, now: datetime) -> tuple[Index, DataFrame]:
    """The index after retention, and counts: branches_evaluated, snapshots_removed, commits_pruned."""
    gone = removals(ix, now)
    after = replace(ix, snapshots=ix.snapshots.join(gone, SNAPSHOT, "left_anti"))
    free = gone.select("repository", "commit_sha").distinct().join(protected_commits(after), ["repository", "commit_sha"], "left_anti")
    evaluated = ix.snapshots.join(ix.policies, ["repository", "branch"], "left_semi").select("repository", "branch").distinct()
    pruned = free.join(ix.files.select("repository", "commit_sha").distinct(), ["repository", "commit_sha"], "left_semi")
    counts = evaluated.agg(F.count("*").alias("branches_evaluated")).crossJoin(gone.agg(F.count("*").alias("snapshots_removed"))).crossJoin(pruned.agg(F.count("*").alias("commits_pruned")))
    return prune_commits(after, free), counts


def prune_repository(ix: Index, repository: str) -> tuple[Index, DataFrame]:
    """The index without a repository, and the rows deleted by table. Rows that go with their policy count once."""
    out = Column.__ne__(F.col("repository"), repository)
    tables = ("files", "branches", "policies", "live", "snapshots", "snapshot_policies")
    counts = None
    for t in tables:
        one = getattr(ix, t).filter(~out).agg(F.lit(t).alias("table"), F.count("*").alias("deleted"))
        counts = one if counts is None else counts.unionByName(one)
    return collect_orphans(replace(ix, **{t: getattr(ix, t).filter(out) for t in tables})), counts


def prune_branch(ix: Index, repository: str, branch: str) -> Index:
    """The index without a branch, and without its commits that nothing else protects."""
    own = (F.col("repository") == repository) & (F.col("branch") == branch)
    k = ["repository", "commit_sha"]
    commits = ix.branches.filter(own).select(k).union(ix.snapshots.filter(own).select(k)).distinct()
    after = replace(ix, **{t: getattr(ix, t).filter(~own) for t in ("branches", "snapshots", "policies", "live", "snapshot_policies")})
    return prune_commits(after, commits.join(protected_commits(after), k, "left_anti"))


def prune_commit(ix: Index, repository: str, commit_sha: str) -> Index:
    """The index without a commit, which no branch may have as its head."""
    own = (F.col("repository") == repository) & (F.col("commit_sha") == commit_sha)
    if not ix.branches.filter(own).isEmpty():
        raise ValueError("the commit is the head of a branch")
    return prune_commits(ix, ix.files.filter(own))


def manual_retention(ix: Index, keep_heads: bool = True, newest: int | None = None) -> DataFrame:
    """(repository, commit_sha, keep) of commits with files: branch heads, and the newest commits of each repository by the
    last time a branch was indexed at them (never: last)."""
    k = ["repository", "commit_sha"]
    seen = ix.branches.groupBy(k).agg(F.max("indexed_at").alias("at"))
    rows = ix.files.select(k).distinct().join(seen, k, "left")
    w = Window.partitionBy("repository").orderBy(F.desc_nulls_last("at"), "commit_sha")
    keep = F.lit(False)
    if keep_heads:
        keep = keep | F.col("at").isNotNull()
    if newest is not None:
        keep = keep | (F.row_number().over(w) <= newest)
    return rows.select(*k, keep.alias("keep"))


def ref_counts(ix: Index) -> DataFrame:
    return ix.mapping.groupBy("chunk_hash").agg(F.count("*").alias("ref_count"))


def unique_symbols(ix: Index) -> DataFrame:
    return ix.symbols.select("name_lc").distinct()


def refresh_symbols(cache: DataFrame, ix: Index) -> DataFrame:
    """The cache with the names it lacks."""
    return cache.unionByName(unique_symbols(ix).join(cache, "name_lc", "left_anti"))


def cleanup_symbols(cache: DataFrame, ix: Index) -> DataFrame:
    """The cache without names that no symbol has."""
    return cache.join(unique_symbols(ix), "name_lc", "left_semi")


def repaired_line_counts(ix: Index) -> tuple[DataFrame, DataFrame]:
    """mapping and blobs with line counts anew from the chunks' texts."""
    from ..functions.columns import line_count

    real = ix.chunks.select("chunk_hash", line_count(F.col("text_content")).alias("real"))
    mapping = ix.mapping.join(real, "chunk_hash", "left").select("content_hash", "chunk_hash", "chunk_index", F.coalesce("real", "chunk_line_count").alias("chunk_line_count"))
    sums = mapping.groupBy(F.col("content_hash").alias("hash")).agg(F.sum("chunk_line_count").cast("int").alias("lines"))
    blobs = ix.blobs.join(sums, "hash", "left").select("hash", "language", "byte_len", F.coalesce("lines", "line_count").alias("line_count"))
    return mapping, blobs
