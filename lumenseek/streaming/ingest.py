"""Incremental ingest as a stream: new files go into append-only tables, branches whose head didn't move are skipped.

Every table is keyed, and a batch appends only keys that the table lacks. So a batch that is run again after a failure,
and a source that is read again, add nothing; a job that fails before its commit leaves no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import chunk
from ..functions.columns import infer_language, line_count, namespace_from_path
from ..functions.extractors import extract
from ..index import SCHEMAS, Index
from ..operators.textindex import postings
from ..operators.upkeep import first_by, missing, upsert
from ..sources.ingest import blobs_of, walk
from ..sources.shared import new_folder

RECORD = "repository string, commit_sha string, file_path string, text string"
HEAD = "repository string, branch string, commit_sha string"
FILE = "repository string, commit_sha string, file_path string, hash string, language string, byte_len long, line_count int, text string"
#: Bytes of text that a task should have: where it is cut into chunks and grams, and where names are extracted.
CHUNKED_A_TASK, EXTRACTED_A_TASK = 32 << 20, 4 << 20
KEYS = {"files": ["repository", "commit_sha", "file_path"], "blobs": ["hash"], "mapping": ["content_hash", "chunk_index"], "chunks": ["chunk_hash"]}
#: Those of what is found in texts, and of branches.
MORE_KEYS = {"symbols": ["symbol_id"], "namespaces": ["namespace_id"], "references": ["symbol_id", "namespace_id", "kind", "line_number", "column_number"], "branches": ["repository", "branch"], "live": ["repository", "branch"], "snapshots": ["repository", "branch", "commit_sha"]}


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path; an empty one with the columns of like where nothing was written yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose keys the table at path lacks; of rows with the same keys the first by all columns."""
    known = stored(rows.sparkSession, path, rows).select(keys)
    first_by(rows, keys, *rows.columns).join(known, keys, "left_anti").write.mode("append").parquet(path)


def ingest_batch(records: DataFrame, path: str) -> None:
    """ingest_files for records(repository, commit_sha, file_path, text); rows with a null text are left out."""
    rows = records.filter("text is not null").select("repository", "commit_sha", "file_path", F.sha2("text", 256).alias("hash"), infer_language(F.col("file_path")).alias("language"), F.octet_length("text").cast("long").alias("byte_len"), line_count(F.col("text")).alias("line_count"), "text")
    ingest_files(rows, path)


def number(text: Column) -> Column:
    """A surrogate key in place of a sequence: the same for the same text in every run."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(15)), 16, 10).cast("long")


def extracted(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, namespaces and references of texts(content_hash, language, file_path, text). Names are extracted once and
    written to the shared folder."""
    rust = F.col("language") == "rust"
    own = F.when(rust, namespace_from_path(F.col("file_path"), rust=True)).otherwise(namespace_from_path(F.col("file_path")))
    rows = extract(texts.select("content_hash", "language", own.alias("namespace"), "text"))
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession, "extracted")
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    namespace = F.coalesce("namespace", F.lit(""))
    rows = rows.select("content_hash", "name", F.lower("name").alias("name_lc"), number(F.concat("content_hash", F.lit(":"), "name")).alias("symbol_id"), namespace.alias("namespace"), number(namespace).alias("namespace_id"), "kind", F.col("line").alias("line_number"), F.col("column").alias("column_number"))
    return (
        rows.select("symbol_id", "content_hash", "name", "name_lc"),
        rows.select("namespace_id", "namespace"),
        rows.select("symbol_id", "namespace_id", "kind", "line_number", "column_number"),
    )


def ingest_files(files: DataFrame, path: str) -> None:
    """Appends the files, blobs, chunk lists, chunks, symbols, namespaces, references and postings of FILE rows; a null text
    is a binary file, which has a blob and no parts. Only contents that the index doesn't know are read: they are asked for
    before any blob is written. Parts go first and files last, so that a file's parts are there when it is."""
    spark = files.sparkSession
    blobs = files.select("hash", "language", "byte_len", "line_count")
    unknown = missing(blobs, stored(spark, f"{path}/blobs", blobs), "hash")
    own = files.filter("text is not null").join(unknown, "hash")
    size = own.agg(F.sum("byte_len")).first()[0] or 0

    def texts(most: int) -> DataFrame:
        """Each text once, at most so many bytes a task, but for a longer text."""
        rows = own.repartition(max(1, -(-size // most)), "hash").groupBy(F.col("hash").alias("content_hash")).agg(F.min(F.struct("file_path", "language")).alias("at"), F.first("text").alias("text"))
        return rows.select("content_hash", "at.*", "text")

    chunks = chunk(texts(CHUNKED_A_TASK).select("content_hash", "text"))
    new = chunks.select("chunk_hash", "text_content")
    known = stored(spark, f"{path}/chunks", new).select("chunk_hash")
    # texts with the same hash are the same: none is sorted by
    lacking = new.repartition(max(1, -(-size // CHUNKED_A_TASK)), "chunk_hash").dropDuplicates(["chunk_hash"]).join(known, "chunk_hash", "left_anti")
    postings(lacking).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")  # repetitions do no harm there
    lacking.write.mode("append").parquet(f"{path}/chunks")
    append_new(chunks.select("content_hash", "chunk_hash", "chunk_index", "chunk_line_count"), f"{path}/mapping", KEYS["mapping"])
    for name, rows in zip(("symbols", "namespaces", "references"), extracted(texts(EXTRACTED_A_TASK)), strict=True):
        append_new(rows, f"{path}/{name}", MORE_KEYS[name])
    append_new(blobs, f"{path}/blobs", KEYS["blobs"])
    key = F.concat_ws("\0", "repository", "commit_sha", "file_path")
    append_new(files.select(number(key).alias("file_id"), "repository", "commit_sha", "file_path", F.col("hash").alias("content_hash")), f"{path}/files", KEYS["files"])


def index_repository(spark: SparkSession, root: str, repository: str, branch: str, commit_sha: str, path: str, indexed_at: datetime, ignored: list[str] | None = None, live: bool = True) -> Index:
    """Walks a folder and adds it to the index under path as a commit of a branch, with all that its files hold. What is
    there already is not added again."""
    own = [F.lit(repository).alias("repository"), F.lit(commit_sha).alias("commit_sha"), F.col("path").alias("file_path")]
    ingest_files(blobs_of(walk(spark, root, ignored)).select(*own, "hash", "language", "byte_len", "line_count", "text"), path)
    head = spark.createDataFrame([(repository, branch, commit_sha, indexed_at)], SCHEMAS["branches"])
    append_new(head, f"{path}/snapshots", MORE_KEYS["snapshots"])
    heads = stored(spark, f"{path}/branches", head)
    renewed = upsert(heads, head, MORE_KEYS["branches"], F.desc("indexed_at")).collect()  # a row for each branch
    spark.createDataFrame(renewed, head.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/branches")
    if live:
        append_new(spark.createDataFrame([(repository, branch, indexed_at)], SCHEMAS["live"]), f"{path}/live", MORE_KEYS["live"])
    for name, schema in SCHEMAS.items():  # tables that nothing went into
        like = spark.createDataFrame([], schema)
        if stored(spark, f"{path}/{name}", like).limit(1).count() == 0:
            like.write.mode("append").parquet(f"{path}/{name}")
    return Index.read(spark, path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that a stream has now, batch by batch."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Ingests a stream of RECORD columns into the tables under path till nothing is left to read."""
    run_available(stream, lambda rows, _: ingest_batch(rows, path), checkpoint)


def changed_heads(heads: DataFrame, log: DataFrame) -> DataFrame:
    """Heads whose commit isn't the last one that log(repository, branch, commit_sha, batch) has for their branch."""
    last = log.groupBy("repository", "branch").agg(F.max_by("commit_sha", "batch").alias("seen"))
    return heads.join(last, ["repository", "branch"], "left").filter(~F.col("commit_sha").eqNullSafe(F.col("seen"))).drop("seen")


def poll(stream: DataFrame, path: str, checkpoint: str, on_changed: Callable[[DataFrame], None]) -> None:
    """Calls on_changed with the heads that moved in each batch of a stream of HEAD columns, then logs them. A branch that
    comes several times in a batch counts once, with its greatest commit name."""

    def each(heads: DataFrame, batch: int) -> None:
        rows = heads.groupBy("repository", "branch").agg(F.max("commit_sha").alias("commit_sha"))
        like = rows.withColumn("batch", F.lit(batch).cast("long"))
        moved = changed_heads(rows, stored(rows.sparkSession, path, like)).withColumn("batch", F.lit(batch).cast("long"))
        on_changed(moved.drop("batch"))
        moved.write.mode("append").parquet(path)

    run_available(stream, each, checkpoint)


def due(repositories: DataFrame, polled: DataFrame, now: datetime) -> DataFrame:
    """Of repositories(repository, interval_seconds) those never polled, or last polled an interval ago or longer, by
    polled(repository, at)."""
    last = polled.groupBy("repository").agg(F.max("at").alias("last"))
    rows = repositories.join(last, "repository", "left")
    waited = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last")
    return rows.filter(F.col("last").isNull() | (waited >= F.col("interval_seconds"))).select("repository", "interval_seconds")


def sweep(spark: SparkSession, repositories: DataFrame, log: str, now: datetime, each: Callable[[str], None], done: Callable[[list[str]], None] | None = None) -> list[str]:
    """Calls each for every due repository, logs that it was polled, and done with their names at the sweep's end. One that
    fails isn't logged, so it stays due; the others go on."""
    like = spark.createDataFrame([], "repository string, at timestamp")
    names = [r.repository for r in due(repositories, stored(spark, log, like), now).orderBy("repository").toLocalIterator()]
    polled = []
    for name in names:
        try:
            each(name)
        except Exception:
            logging.getLogger(__name__).exception("polling %s failed", name)
        else:
            polled.append(name)
    if polled:
        spark.createDataFrame([(n, now) for n in polled], like.schema).write.mode("append").parquet(log)
    if done:
        done(polled)
    return polled


#: Seconds between background collections: the least, and the default.
GC_LEAST, GC_DEFAULT = 60, 3600


def repeatedly(spark: SparkSession, each: Callable[[int], None], checkpoint: str, seconds: int | None = GC_DEFAULT) -> StreamingQuery | None:
    """Calls each with a running number every max(GC_LEAST, seconds) seconds, from now on till the query is stopped; None:
    never."""
    if seconds is None:
        return None
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: each(n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(GC_LEAST, seconds)} seconds").start()
