"""Symbol search, references and insights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fully_qualified, in_paths, symbol_weight
from ..index import Index
from ..plans.language import java_regex


@dataclass(frozen=True)
class SymbolRequest:
    q: str | None = None  # chunks have to hold it, as a case-sensitive LIKE pattern
    name: str | None = None
    name_regex: str | None = None
    namespace: str | None = None
    namespace_prefix: str | None = None
    kinds: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    repository: str | None = None
    commit_sha: str | None = None
    path: str | None = None  # part of the path, in any letter case
    path_regex: str | None = None
    path_hint: str | None = None
    include_paths: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    include_references: bool = False
    limit: int | None = field(default=100)

    @property
    def needle(self) -> str | None:
        return self.name or self.q


def places(ix: Index) -> DataFrame:
    """Every reference of every symbol in every file that has its blob."""
    refs = ix.occurrences().join(ix.namespaces, "namespace_id")
    blobs = ix.blobs.select(F.col("hash").alias("content_hash"), "language")
    return refs.join(ix.files, "content_hash").join(blobs, "content_hash", "left")


def named(rows: DataFrame, r: SymbolRequest) -> DataFrame:
    """Rows whose name the request wants."""
    for test in (r.name and F.col("name") == r.name, r.name_regex and F.col("name").rlike(r.name_regex)):
        if isinstance(test, Column):
            rows = rows.filter(test)
    return rows


def filtered(ix: Index, r: SymbolRequest) -> DataFrame:
    rows = named(places(ix), r)
    kind = F.coalesce("kind", F.lit("definition"))
    for test in (
        r.namespace and F.col("namespace") == r.namespace,
        r.namespace_prefix and F.col("namespace").like(r.namespace_prefix + "%"),
        r.kinds and kind.isin(*r.kinds),
        r.languages and F.col("language").isin(*r.languages),
        r.repository and F.col("repository") == r.repository,
        r.commit_sha and F.col("commit_sha") == r.commit_sha,
        r.path and F.col("file_path").ilike(f"%{r.path}%"),
        r.path_regex and F.col("file_path").rlike(java_regex("(?m)" + r.path_regex, False)),
        r.include_paths and in_paths(F.col("file_path"), list(r.include_paths)),
        r.excluded_paths and ~in_paths(F.col("file_path"), list(r.excluded_paths)),
    ):
        if isinstance(test, Column):  # else that part of the request is empty
            rows = rows.filter(test)
    if r.q:
        hashes = ix.placed().filter(F.col("text_content").like(f"%{r.q}%")).select("content_hash").distinct()
        rows = rows.join(hashes, "content_hash", "left_semi")
    return rows


def search_symbols(ix: Index, r: SymbolRequest) -> DataFrame:
    """Each symbol at its best place, by weight, then name. limit: 1 to 1000; None for all."""
    qualified = fully_qualified(F.col("namespace"), F.col("name"))
    namespace = F.nullif(F.col("namespace"), F.lit(""))
    kind = F.coalesce("kind", F.lit("definition"))
    rows = filtered(ix, r).select(
        "symbol_id", "content_hash", F.col("name").alias("symbol"), namespace.alias("namespace"), kind.alias("kind"), qualified.alias("fully_qualified"), "language", "repository", "commit_sha", "file_path", "line_number", "column_number",
        symbol_weight(F.col("name"), qualified, namespace, kind, F.col("file_path"), r.needle, r.namespace or r.namespace_prefix, r.path_hint or r.path).alias("score"),
        (F.col("kind") == "definition").alias("defined"),
    )
    best = Window.partitionBy("symbol_id").orderBy(F.desc("score"), F.desc_nulls_first("defined"), "line_number", "column_number", "repository", "commit_sha", "file_path")
    out = rows.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth", "defined")
    if r.limit is not None:
        out = out.orderBy(F.desc("score"), "symbol", "content_hash").limit(max(1, min(r.limit, 1000)))
    if r.include_references:
        own = named(ix.occurrences(), r).join(out.select("symbol_id"), "symbol_id", "left_semi").join(ix.namespaces, "namespace_id")
        each = own.select("symbol_id", F.struct("line_number", "column_number", "kind", F.nullif(F.col("namespace"), F.lit("")).alias("namespace")).alias("ref"))
        refs = each.groupBy("symbol_id").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
        place = lambda r: F.struct(r["namespace"].alias("namespace"), F.col("symbol").alias("name"), r["kind"].alias("kind"), r["line_number"].alias("line"), r["column_number"].alias("column"), "repository", "commit_sha", "file_path")
        out = out.join(refs, "symbol_id", "left").withColumn("references", F.transform("refs", place)).drop("refs")
    return out


def symbol_references(ix: Index, repository: str, commit_sha: str, name: str, namespace: str | None = None, position: tuple[str, int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Places of a symbol in a commit. position (path, line, column): the symbols defined there, at most 8; without one or
    where none is there, those of the name and namespace."""
    rows = places(ix).filter((F.col("repository") == repository) & (F.col("commit_sha") == commit_sha) & (F.col("name") == name))
    if position is not None:
        path, line, column = position
        at = rows.filter((F.col("file_path") == path) & (F.col("line_number") == line) & (F.col("column_number") == column) & (F.col("kind") == "definition")).select("symbol_id").distinct().limit(8)
        rows = rows.join(at, "symbol_id", "left_semi")
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    out = rows.select("repository", "commit_sha", "file_path", "name", "namespace", "kind", "line_number", "column_number").orderBy("file_path", "line_number", "column_number")
    return out if limit is None else out.limit(limit)
