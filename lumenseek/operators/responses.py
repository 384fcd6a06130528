"""Composed answers: a page with snippets, a batch of searches, a symbol's places in context, a file or directory view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import snippets
from ..functions.columns import permalink
from ..index import Index
from ..plans.language import Request, compile_query, request
from . import content, facets, paths, search, symbols, upkeep

MAX_TERMS = 8
DEDUP = ("repo_path_line", "repo_path", "none")


def definition_lines(ix: Index, terms: list[str], contents: DataFrame) -> DataFrame:
    """(content_hash, line) where one of the terms is defined, in the given contents."""
    names = ix.occurrences().filter(F.col("name_lc").isin(*terms) & (F.col("kind") == "definition"))
    return search.among(names, contents).select("content_hash", F.col("line_number").alias("line"))


def with_snippets(ix: Index, results: DataFrame, r: Request, context: int = 3) -> DataFrame:
    """results with match_line and snippets, the best first; only the results' own chunks are read."""
    own = Index(**{**ix.__dict__, "mapping": search.among(ix.mapping, results)})
    if ix.places is None:
        texts = ix.chunks.join(results.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    else:
        texts = ix.places.join(results.select("content_hash", "chunk_index").distinct(), ["content_hash", "chunk_index"], "left_semi").select("chunk_hash", "text_content").distinct()
    defined = definition_lines(ix, r.definition_terms, results) if r.definition_terms else None
    found = snippets.page_snippets(results, texts, content.chunk_start_lines(own), defined, context)
    each = F.struct("nth", "start_line", "end_line", "match_line", "content_text", "match_spans")
    found = found.groupBy("file_id").agg(F.array_sort(F.collect_list(each)).alias("snippets"))
    return results.join(found, "file_id", "left").withColumn("match_line", F.get(F.col("snippets.match_line"), F.lit(0)))


def held(page: DataFrame) -> DataFrame:
    """A page, of page_size rows at most, as a local table: its search runs once, whatever is joined to it."""
    return page.sparkSession.createDataFrame(page.collect(), page.schema)


def page(ix: Index, r: Request, context: int = 3) -> DataFrame:
    """One page of results, each with its snippets, its link and the place to open."""
    rows = with_snippets(ix, held(search.search(ix, r)), r, context)
    return enriched(rows.select(*search.RESULT, "position", "match_line", "snippets")).orderBy("position")


def enriched(rows: DataFrame) -> DataFrame:
    """rows with permalink and open_at_line(repo, branch_or_commit, path, line) of their match_line, 1 at least."""
    line = F.greatest(F.coalesce("match_line", F.lit(1)), F.lit(1))
    place = F.struct(F.col("repository").alias("repo"), F.col("commit_sha").alias("branch_or_commit"), F.col("file_path").alias("path"), line.alias("line"))
    return rows.withColumn("permalink", permalink(F.col("repository"), F.col("commit_sha"), F.col("file_path"), line)).withColumn("open_at_line", place)


@dataclass(frozen=True)
class Batch:
    results: DataFrame
    counts: DataFrame  # (query_ord, any_term, count, has_more)
    deduped_count: DataFrame  # (deduped_count)
    file_types: DataFrame
    freshness: DataFrame


def batch(ix: Index, any_terms: list[str], all_terms: list[str] | None = None, dedupe: str = "repo_path_line", most: int = 25, **filters: list[str] | str | bool | None) -> Batch:
    """A search for each of at most MAX_TERMS any_terms together with all_terms and the filters. The first page of each, at
    most `most` results, in the order of the terms; what several find comes once, at its first place."""
    terms = [t.strip() for t in any_terms if t.strip()]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"too many any_terms: {MAX_TERMS} at most")
    if not terms:
        raise ValueError("a batch needs any_terms")
    if dedupe not in DEDUP:
        raise ValueError(f"dedupe is one of {', '.join(DEDUP)}")
    most = max(1, most)
    parts, counts = [], []
    for n, term in enumerate(terms):
        words = " ".join(f'"{w.strip()}"' for w in [*(all_terms or []), term] if w.strip())
        r = request(compile_query(words, **filters))
        found = held(search.search(ix, r).filter(F.col("position") <= most))
        rows = with_snippets(ix, found, r)
        parts.append(rows.select(F.lit(n).alias("query_ord"), F.lit(term).alias("any_term"), F.col("position").alias("rank"), *search.RESULT, "snapshot_indexed_at", "match_line", "snippets", F.col("match_line").alias("line")))
        counts.append(search.has_more(ix, r).select(F.lit(n).alias("query_ord"), F.lit(term).alias("any_term"), F.least(F.col("total"), F.lit(min(most, r.page_size))).alias("count"), "has_more"))
    results = upkeep.batch_dedup(reduce(DataFrame.unionByName, parts), dedupe)
    out = enriched(results.drop("line")).orderBy("query_ord", "rank")
    return Batch(out, reduce(DataFrame.unionByName, counts), results.agg(F.count("*").alias("deduped_count")), facets.file_types(results), facets.freshness(results))


def resolved_commit(ix: Index, repository: str, branch: str) -> str:
    """The branch's head, or the name itself where no branch has it: a lookup of one row."""
    return paths.branch_head(ix, repository, branch).first()[0]


def directory_prefix(path: str) -> str | None:
    """The directory of a path; a path that ends with a slash is one. None at the top."""
    bare = path.strip("/")
    return (bare if path.endswith("/") else bare.rpartition("/")[0]) or None


def insights(ix: Index, repository: str, branch: str, name: str, scope: str = "repository", path: str = "", language: str | None = None, include_paths: tuple[str, ...] = (), excluded_paths: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """A name's symbols, of any kind, at their best places, and every reference of each with a line of context each way:
    one row a reference. scope: repository; directory or file (of path, which then is a part of the wanted paths); custom
    (include_paths). A reference whose lines aren't stored has a null snippet."""
    if not name.strip():
        raise ValueError("a symbol is needed")
    directory, file = directory_prefix(path), path.strip("/") or None
    part = {"directory": directory, "file": file}.get(scope)
    hint = part if scope in ("directory", "file") else directory or file
    r = symbols.SymbolRequest(name=name, repository=repository, commit_sha=resolved_commit(ix, repository, branch), path=part, path_hint=hint, languages=(language,) if language else (), include_paths=tuple(sorted(set(include_paths))), excluded_paths=tuple(sorted(set(excluded_paths))), include_references=True, limit=limit)
    keys = ["repository", "commit_sha", "file_path"]
    found = symbols.search_symbols(ix, r).select(*keys, "symbol", "namespace", "kind", "line_number", "column_number", "score", F.explode_outer("references").alias("reference"))
    found = found.withColumn("line", F.greatest(F.col("reference.line"), F.lit(1)))
    lines = content.file_snippets(ix, found.select(*keys, "line").filter("line is not null").distinct(), 1).select(*keys, "line", "start_line", "end_line", "snippet")
    return found.join(lines, [*keys, "line"], "left").drop("line")


def snippet_has(snippet: Column, needle: str) -> Column:
    """Whether a line of a snippet has the needle, in any letter case; an empty needle is in all, no snippet has another."""
    if not needle:
        return F.lit(True)
    return F.coalesce(F.exists(F.split(snippet, "\n", -1), lambda line: F.contains(F.lower(line), F.lit(needle.lower()))), F.lit(False))


def directory_view(ix: Index, repository: str, branch: str, path: str = "") -> tuple[DataFrame, DataFrame]:
    """(kind, name, path) of a directory's entries, and the text of its readme.md, if it has one."""
    commit = resolved_commit(ix, repository, branch)
    files = ix.files.filter((F.col("repository") == repository) & (F.col("commit_sha") == commit))
    entries = paths.tree(files, path).select("kind", "name", "path")
    readme = entries.filter((F.lower("name") == "readme.md") & (F.col("kind") == "file")).orderBy("path").limit(1)
    own = files.join(readme.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return entries, content.file_contents(ix, own).select("file_path", "text")


def file_view(ix: Index, files: DataFrame) -> DataFrame:
    """(repository, commit_sha, file_path, kind, language, line_count, text, download): kind is file, or binary for a file
    without a language whose text isn't stored or has a NUL; a binary file has a download link and no text."""
    rows = content.file_contents(ix, files)
    text = F.col("text")
    binary = F.col("language").isNull() & (text.isNull() | F.contains(text, F.lit("\0")))
    lines = F.size(F.split(text, "\n", -1)) - F.when((text == "") | F.endswith(text, F.lit("\n")), 1).otherwise(0)
    link = F.concat(F.lit("/api/download_raw?repo="), "repository", F.lit("&branch="), "commit_sha", F.lit("&path="), "file_path")
    return rows.select("repository", "commit_sha", "file_path", F.when(binary, "binary").otherwise("file").alias("kind"), "language", F.when(~binary, lines).alias("line_count"), F.when(~binary, text).alias("text"), F.when(binary, link).alias("download"))


def healthy(spark: SparkSession, ix: Index | None = None) -> DataFrame:
    """(ok): that the session answers and, with an index, that its tables can be read."""
    rows = spark.range(1).select(F.lit(True).alias("ok"))
    if ix is not None:
        rows = rows.filter(F.lit(ix.files.limit(1).count() >= 0))
    return rows
