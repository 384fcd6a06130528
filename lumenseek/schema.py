"""Spark schemas of the index tables."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """Without a session, unlike the parser of Spark."""
    columns = (c.split(" ", 2) for c in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind], not null) for name, kind, *null in columns])


FILES = _struct("file_id long NOT NULL, repository string NOT NULL, commit_sha string NOT NULL, file_path string NOT NULL, content_hash string NOT NULL")
CONTENT_BLOBS = _struct("hash string NOT NULL, language string, byte_len long NOT NULL, line_count int NOT NULL")
CHUNKS = _struct("chunk_hash string NOT NULL, text_content string NOT NULL")
CONTENT_BLOB_CHUNKS = _struct("content_hash string NOT NULL, chunk_hash string NOT NULL, chunk_index int NOT NULL, chunk_line_count int NOT NULL")
SYMBOLS = _struct("symbol_id long NOT NULL, content_hash string NOT NULL, name string NOT NULL, name_lc string NOT NULL")
SYMBOL_NAMESPACES = _struct("namespace_id long NOT NULL, namespace string NOT NULL")
SYMBOL_REFERENCES = _struct("symbol_id long NOT NULL, namespace_id long NOT NULL, kind string, line_number int NOT NULL, column_number int NOT NULL")
BRANCHES = _struct("repository string NOT NULL, branch string NOT NULL, commit_sha string NOT NULL, indexed_at timestamp NOT NULL")
BRANCH_SNAPSHOTS = BRANCHES
LIVE_BRANCHES = _struct("repository string NOT NULL, branch string NOT NULL, updated_at timestamp")
BRANCH_POLICIES = _struct("repository string NOT NULL, branch string NOT NULL, latest_keep_count int NOT NULL")
SNAPSHOT_POLICIES = _struct("repository string NOT NULL, branch string NOT NULL, interval_seconds long NOT NULL, keep_count int NOT NULL")
UPLOAD_CHUNKS = _struct("upload_id string NOT NULL, chunk_index int NOT NULL, total_chunks int NOT NULL, data binary NOT NULL")
SPAN = _struct("start int NOT NULL, end int NOT NULL")
SPANS = T.ArrayType(SPAN, False)
