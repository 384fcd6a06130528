"""Trees, path search, listings and completion over file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..index import Index
from ..plans.language import escape_like


#: What an interactive tool answers at most: pages followed, list entries, rows a listing is made from.
PAGES, LIST_ENTRIES, SOURCE_ROWS = 5, 5000, 200_000


def tree(files: DataFrame, prefix: str = "") -> DataFrame:
    """Immediate children of a directory: (repository, commit_sha, kind, name, path), directories first."""
    at = prefix.strip("/")
    if at:
        files = files.filter((F.col("file_path") == at) | F.col("file_path").like(escape_like(at) + "/%"))
    rest = F.substring("file_path", len(at) + 2 if at else 1, 1 << 30)
    child = F.substring_index(rest, "/", 1)
    kind = F.when(F.contains(rest, F.lit("/")), "dir").otherwise("file")
    rows = files.filter(F.length(rest) > 0).select("repository", "commit_sha", kind.alias("kind"), child.alias("name")).distinct()
    return rows.withColumn("path", F.concat(F.lit(at + "/" if at else ""), "name")).orderBy("repository", "kind", "name")


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def all_directories(files: DataFrame) -> DataFrame:
    """(repository, path) of every directory above a file."""
    return files.select("repository", F.explode(ancestors(F.col("file_path"))).alias("path")).distinct()


def search_paths(files: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Files and directories whose path has the needle in any letter case: (repository, kind, path), directories first.
    limit: the first so many, 200 at most."""
    has = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    own = files.filter(has(F.col("file_path"))).select("repository", "file_path")
    dirs = all_directories(own).filter(has(F.col("path"))).select("repository", F.lit("dir").alias("kind"), "path")
    found = dirs.unionByName(own.select("repository", F.lit("file").alias("kind"), F.col("file_path").alias("path")).distinct()).orderBy("kind", "path", "repository")
    return found if limit is None else found.limit(max(1, min(limit, 200)))


def listed(files: DataFrame, root: str = "", depth: int = 1) -> DataFrame:
    """(repository, kind, path) of files and directories at most depth levels (1 to 10) under a root."""
    depth = max(1, min(depth, 10))
    at = root.strip("/")
    if at:
        files = files.filter(F.startswith("file_path", F.lit(at + "/")))
    skip = at.count("/") + 1 if at else 0
    every = F.concat(ancestors(F.col("file_path")), F.array("file_path"))
    rows = files.select("repository", "file_path", F.posexplode(F.slice(every, skip + 1, depth)).alias("k", "path"))
    kind = F.when(F.col("path") == F.col("file_path"), "file").otherwise("dir")
    return rows.select("repository", kind.alias("kind"), "path").distinct().orderBy("kind", "path", "repository")


def page(rows: DataFrame, cursor: int, size: int, *order: str | Column) -> DataFrame:
    """Rows cursor to cursor + size of an order (a numeric cursor)."""
    return rows.orderBy(*order).offset(max(0, cursor)).limit(max(1, size))


def paged(rows: DataFrame, cursor: int, size: int, *order: str | Column, pages: int = 1, cap: int | None = None) -> tuple[DataFrame, int | None]:
    """Rows of several pages (PAGES at most) from a numeric cursor, no more than cap, and the next cursor; None at the end."""
    start, most = max(0, cursor), max(1, size) * max(1, min(pages, PAGES))
    most = most if cap is None else min(most, cap)
    some = rows.orderBy(*order).offset(start)
    return some.limit(most), start + most if some.limit(most + 1).count() > most else None


def prefetched_paths(files: DataFrame, needle: str, limit: int) -> DataFrame:
    """search_paths over the first clamp(5 * limit, 1, 200) matching files by path only, cut at limit: the quick answer that
    looks no further; search_paths() is the whole one."""
    own = files.filter(F.contains(F.lower("file_path"), F.lit(needle.lower()))).orderBy("file_path", "repository").limit(max(1, min(5 * limit, 200)))
    return search_paths(own, needle, limit)


def listed_capped(files: DataFrame, root: str = "", depth: int = 1, source: int = SOURCE_ROWS, entries: int = LIST_ENTRIES) -> DataFrame:
    """listed() over at most so many files in the order of paths, and at most so many entries: for an interactive tool."""
    return listed(files.orderBy("file_path").limit(source), root, depth).limit(entries)


def _limit(n: int) -> int:
    return max(1, min(n, 20))


def complete_values(values: DataFrame, column: str, typed: str, limit: int = 10) -> DataFrame:
    """Distinct values that hold what is typed, in any letter case, in order."""
    return values.select(F.col(column).alias("value")).filter(F.contains(F.lower("value"), F.lit(typed.lower()))).distinct().orderBy("value").limit(_limit(limit))


def complete_repositories(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    return complete_values(ix.files, "repository", typed, limit)


def complete_files(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    return complete_values(ix.files, "file_path", typed, limit)


def complete_languages(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    return complete_values(ix.blobs.filter(F.col("language").isNotNull()), "language", typed, limit)


def complete_branches(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    return complete_values(ix.branches.select("branch").union(ix.snapshots.select("branch")), "branch", typed, limit)


def complete_paths(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    """Directories, each as prefix/*."""
    from ..functions.columns import directory

    return complete_values(ix.files.select(directory(F.col("file_path")).alias("d")), "d", typed, limit)


def complete_symbols(ix: Index, typed: str, limit: int = 10) -> DataFrame:
    """(name_lc, repository, file_path) of names that begin with what is typed: the first in order, with the least place."""
    names = ix.symbols.filter(F.startswith("name_lc", F.lit(typed.lower())))
    picked = names.select("name_lc").distinct().orderBy("name_lc").limit(_limit(limit))
    return names.join(F.broadcast(picked), "name_lc").join(ix.files.select("content_hash", "repository", "file_path"), "content_hash").groupBy("name_lc").agg(F.min("repository").alias("repository"), F.min("file_path").alias("file_path")).orderBy("name_lc")


def repository_counts(ix: Index, limit: int | None = None) -> DataFrame:
    """(repository, file_count) of repositories with a live branch: files at the live branch's commits."""
    from .search import live_commits

    at = ix.files.join(live_commits(ix), ["repository", "commit_sha"], "left_semi").groupBy("repository").agg(F.count("*").alias("n"))
    out = ix.live.select("repository").distinct().join(at, "repository", "left").select("repository", F.coalesce("n", F.lit(0)).cast("long").alias("file_count")).orderBy("repository")
    return out if limit is None else out.limit(max(1, min(limit, 50)))


def latest_snapshots(ix: Index) -> DataFrame:
    """(repository, branch, snapshot_at) of each branch's last snapshot."""
    return ix.snapshots.groupBy("repository", "branch").agg(F.max("indexed_at").alias("snapshot_at"))


def repository_branches(ix: Index) -> DataFrame:
    """(repository, branch, commit_sha, indexed_at, is_live); repositories without branches have their commits as such."""
    own = ix.branches.join(latest_snapshots(ix), ["repository", "branch"], "left").select("repository", "branch", "commit_sha", F.coalesce("snapshot_at", "indexed_at").alias("indexed_at"))
    live = ix.live.select("repository", "branch", F.lit(True).alias("is_live"))
    own = own.join(live, ["repository", "branch"], "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))
    bare = ix.files.join(ix.branches.select("repository").distinct(), "repository", "left_anti").select("repository", F.col("commit_sha").alias("branch"), "commit_sha").distinct()
    return own.unionByName(bare.select("*", F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(False).alias("is_live")))


def branch_head(ix: Index, repository: str, branch: str) -> DataFrame:
    """The branch's commit; where there is none the name itself, taken as a commit."""
    head = ix.branches.filter((F.col("repository") == repository) & (F.col("branch") == branch))
    return head.agg(F.coalesce(F.first("commit_sha"), F.lit(branch)).alias("commit_sha"))


def commits(ix: Index, repository: str) -> DataFrame:
    return ix.files.filter(F.col("repository") == repository).select("commit_sha").distinct().orderBy(F.desc("commit_sha"))
