"""Files from their chunks: whole contents, slices, snippets by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import basename, line_slice
from ..index import Index

MAX_CONTEXT = 3


def chunk_places(ix: Index) -> DataFrame:
    """Every chunk in every file that has it."""
    return ix.chunks.join(ix.mapping, "chunk_hash").join(ix.files, "content_hash")


def chunk_start_lines(ix: Index) -> DataFrame:
    """(content_hash, chunk_index, chunk_hash, start_line): lines before a chunk, from 1."""
    before = Window.partitionBy("content_hash").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(1) + F.coalesce(F.sum("chunk_line_count").over(before), F.lit(0))
    return ix.mapping.select("content_hash", "chunk_index", "chunk_hash", start.cast("int").alias("start_line"))


def reassembled(ix: Index, hashes: DataFrame | None = None) -> DataFrame:
    """(content_hash, text): chunks joined in their order. hashes: only these blobs, filtered before the texts move."""
    places = ix.placed() if hashes is None else ix.placed().join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
    parts = places.groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text_content"))).alias("parts"))
    return parts.select("content_hash", F.array_join(F.col("parts.text_content"), "").alias("text"))


def file_contents(ix: Index, files: DataFrame | None = None) -> DataFrame:
    """(repository, commit_sha, file_path, language, text); a file without chunks is binary and has a null text."""
    files = ix.files if files is None else files
    blobs = ix.blobs.select(F.col("hash").alias("content_hash"), "language")
    return files.join(blobs, "content_hash", "left").join(reassembled(ix, files), "content_hash", "left").select("repository", "commit_sha", "file_path", "language", "text")


def file_snippets(ix: Index, wanted: DataFrame, context: int = MAX_CONTEXT) -> DataFrame:
    """Lines around wanted(repository, commit_sha, file_path, line): at most MAX_CONTEXT each way. Files that aren't there
    are left out; missing_files() names them."""
    n = max(0, min(context, MAX_CONTEXT))
    hit = ix.files.join(wanted, ["repository", "commit_sha", "file_path"])
    rows = hit.join(reassembled(ix, hit), "content_hash")
    lines = F.size(F.split("text", "\n", -1))
    line = F.least(F.greatest(F.col("line"), F.lit(1)), lines)
    first, last = F.greatest(line - n, F.lit(1)), F.least(line + n, lines)
    return rows.select("repository", "commit_sha", "file_path", "line", first.alias("start_line"), last.alias("end_line"), lines.alias("total_lines"), line_slice(F.col("text"), first, last).alias("snippet"), (last < lines).alias("truncated"))


def context_lines(text: Column, line: Column, context: int = MAX_CONTEXT) -> Column:
    """Numbered lines around a line, clamped to the text: the rows of a series, as an array to explode."""
    lines = F.split(text, "\n", -1)
    n = F.least(F.greatest(line, F.lit(1)), F.size(lines))
    series = F.sequence(F.greatest(n - context, F.lit(1)), F.least(n + context, F.size(lines)))
    return F.transform(series, lambda i: F.struct(i.alias("line"), F.get(lines, i - 1).alias("text"), (i == n).alias("is_match")))


def missing_files(ix: Index, wanted: DataFrame) -> DataFrame:
    return wanted.join(ix.files, ["repository", "commit_sha", "file_path"], "left_anti")


def sliced(ix: Index, files: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines start to end of files; what is out of range is clamped, a reversed range is refused."""
    if start is not None and end is not None and start > end:
        raise ValueError("start_line is after end_line")
    rows = file_contents(ix, files)
    total = F.size(F.split("text", "\n", -1))
    first = F.greatest(F.lit(start or 1), F.lit(1))
    last = F.least(F.lit(end) if end is not None else total, total)
    return rows.select("repository", "commit_sha", "file_path", total.alias("total_lines"), first.alias("start_line"), last.alias("end_line"), line_slice(F.col("text"), first, last).alias("content"))


def readmes(ix: Index, directory: str = "") -> DataFrame:
    """Each repository and commit's README of a directory, the first by path."""
    at = directory.strip("/") + "/" if directory.strip("/") else ""
    own = ix.files.filter(F.startswith("file_path", F.lit(at)) & ~F.contains(F.substring("file_path", len(at) + 1, 1 << 30), F.lit("/")) & F.lower(basename(F.col("file_path"))).rlike(r"^readme(\.[a-z]+)?$"))
    w = Window.partitionBy("repository", "commit_sha").orderBy("file_path")
    return own.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
