"""Reading repositories and the wire formats of an index, and writing them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import infer_language, line_count, relative_path, skipped_path

#: Files that a task of walk() reads.
FILES_A_TASK = 200


def walk(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path, content) of all files under a folder, hidden ones too, but for build folders and ignored paths. ignored:
    lines as in .gitignore (globs; a trailing slash for folders; a leading one for the root; ! takes a path back). Every
    folder's own .gitignore counts for what is under it, the deepest last."""
    # Spark's own file source leaves hidden files out: the listing is made here, contents are read by the executors
    where = root if "://" in root else os.path.abspath(root)
    store, base = fs.FileSystem.from_uri(where)
    found = [(f.path,) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    listed = spark.createDataFrame(found, "full string").withColumn("path", relative_path(F.col("full"), base))
    rows = listed.filter(F.col("path").isNotNull() & ~skipped_path(F.col("path")))
    rules = [("", line) for line in ignored or []]
    inner = sorted((f[0] for f in found if f[0].rsplit("/", 1)[-1] == ".gitignore"), key=lambda p: p.count("/"))
    for full in inner:
        with store.open_input_stream(full) as f:
            folder = full.removeprefix(base.rstrip("/") + "/").rpartition("/")[0]
            rules += [(folder, line) for line in f.read().decode(errors="replace").split("\n")]
    keep = F.lit(True)
    for folder, line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        under = F.lit(True) if not folder else F.startswith("path", F.lit(folder + "/"))
        rest = F.col("path") if not folder else F.substring("path", len(folder) + 2, 1 << 30)
        keep = F.when(under & rest.rlike(ignore_regex(line.lstrip("!"))), F.lit(back)).otherwise(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fs.FileSystem.from_uri(where)[0]
        for batch in batches:
            for full, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with own.open_input_stream(full) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    parts = max(1, -(-len(found) // FILES_A_TASK))
    return rows.filter(keep).select("full", "path").repartition(parts, "path").mapInArrow(read, "path string, content binary")


def write_files(rows: DataFrame, root: str) -> None:
    """Writes each row(path, text) as a file under a folder that all executors share."""
    where = root if "://" in root else os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("path", "text").mapInArrow(run, "n long").count()


def ignore_regex(rule: str) -> str:
    folder = rule.endswith("/")
    body = rule.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    anchored = rule.startswith("/") or "/" in body
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '(?:/|$)'}"


def is_text(content: Column) -> Column:
    """Whether bytes are UTF-8 without a NUL."""
    hexed = F.hex(content)
    return F.is_valid_utf8(content.cast("string")) & ~hexed.rlike("^(?:..)*?00")


def blobs_of(walked: DataFrame) -> DataFrame:
    """(path, hash, language, byte_len, line_count, text); binary files have a null text and no lines."""
    text = F.when(is_text(F.col("content")), F.col("content").cast("string"))
    rows = walked.select("path", F.sha2("content", 256).alias("hash"), infer_language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("byte_len"), text.alias("text"))
    return rows.select("path", "hash", "language", "byte_len", F.coalesce(line_count(F.col("text")), F.lit(0)).alias("line_count"), "text")


SECTIONS = {
    "content_blob": "hash string, language string, byte_len long, line_count int",
    "file_entry": "repository string, commit_sha string, file_path string, content_hash string",
    "symbol_record": "content_hash string, name string",
    "symbol_namespace": "namespace string",
    "reference_record": "content_hash string, namespace string, name string, kind string, line int, column int",
    "branch_head": "repository string, branch string, commit_sha string",
}


def write_manifest(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON line a record: its section and its payload."""
    out = None
    for section, rows in tables.items():
        line = rows.select(F.to_json(F.struct(F.lit(section).alias("section"), F.struct(*rows.columns).alias("payload"))).alias("value"))
        out = line if out is None else out.unionByName(line)
    out.write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by section; blank lines are skipped, and blobs, which are sent on their own, are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    found = {}
    for section, columns in SECTIONS.items():
        if section != "content_blob":
            parsed = lines.select(F.from_json("value", f"section string, payload struct<{', '.join(c.replace(' ', ':') for c in columns.split(', '))}>").alias("r"))
            found[section] = parsed.filter(F.col("r.section") == section).select("r.payload.*")
    return found


def shards(rows: DataFrame, section: str, records: int = 50_000, most: int = 4 << 20) -> DataFrame:
    """(section, records, raw_bytes, payload): JSON lines of rows in shards of at most so many records and bytes (a longer
    record is a shard of its own), each zstd-compressed and in base64. Shards are cut inside partitions: no shuffle."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import zstandard

        held: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            raw = b"".join(held)
            text = base64.b64encode(zstandard.ZstdCompressor().compress(raw)).decode()
            return pa.RecordBatch.from_arrays([pa.array([section]), pa.array([len(held)], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([text])], ["section", "records", "raw_bytes", "payload"])

        for batch in batches:
            for line in batch.column(0).to_pylist():
                one = line.encode() + b"\n"
                if held and (len(held) == records or size + len(one) > most):
                    yield packed()
                    held.clear()
                    size = 0
                held.append(one)
                size += len(one)
        if held:
            yield packed()

    return lines.mapInArrow(run, "section string, records int, raw_bytes long, payload string")


def records_of(shards: DataFrame, section: str, schema: str) -> DataFrame:
    """The records of a section's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import zstandard

        for batch in batches:
            for payload in batch.column(0).to_pylist():
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(base64.b64decode(payload))
                yield pa.RecordBatch.from_arrays([pa.array(raw.decode().split("\n")[:-1])], ["line"])

    own = shards.filter(F.col("section") == section).select("payload").mapInArrow(run, "line string")
    return own.select(F.from_json("line", schema).alias("r")).select("r.*")


class Spool:
    """Records kept on disk by type: appended a table at a time, read back whole or in batches of bounded size."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, section: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(f"{self.path}/{section}")

    def read(self, section: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.path}/{section}")

    def batches(self, section: str, schema: str, records: int = 50_000) -> Iterator[pa.Table]:
        """Tables of at most so many records, one at a time on the driver."""
        rows = self.read(section, schema)
        for part in rows.withColumn("_part", F.spark_partition_id()).select("_part").distinct().orderBy("_part").collect():
            whole = rows.filter(F.spark_partition_id() == part[0]).toArrow()
            for k in range(0, whole.num_rows, records):
                yield whole.slice(k, records)


def write_report(tables: dict[str, DataFrame], path: str, rows_per_file: int = 50_000) -> None:
    """JSON files by table, of bounded size."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(f"{path}/{name}")


def reassemble_uploads(parts: DataFrame, compressed: bool = False) -> DataFrame:
    """(upload_id, data, error) of upload chunks: joined in order if they are as many as each says and their numbers run
    from 0 without gap; else an error and null data. compressed: zstd."""
    rows = parts.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("p"), F.min("total_chunks").alias("lo"), F.max("total_chunks").alias("hi"))
    order = F.col("p.chunk_index")
    error = F.when(F.col("lo") != F.col("hi"), "chunks disagree about their number").when(F.size("p") != F.col("hi"), "chunks are missing").when(order != F.sequence(F.lit(0), F.size("p") - 1), "chunk numbers have gaps")
    whole = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    out = rows.select("upload_id", F.when(error.isNull(), whole).alias("data"), error.alias("error"))
    if not compressed:
        return out

    @F.pandas_udf("binary")
    def unpacked(data):  # noqa: ANN001, ANN202
        import zstandard

        d = zstandard.ZstdDecompressor()
        return data.map(lambda b: None if b is None else d.decompressobj().decompress(b))

    return out.withColumn("data", unpacked("data"))


