"""The index: a bundle of DataFrames, read from Parquet or derived."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from . import schema
from .operators.textindex import write_postings


@dataclass(frozen=True)
class Index:
    files: DataFrame
    blobs: DataFrame
    mapping: DataFrame
    chunks: DataFrame
    symbols: DataFrame
    namespaces: DataFrame
    references: DataFrame
    branches: DataFrame
    live: DataFrame
    snapshots: DataFrame
    policies: DataFrame
    snapshot_policies: DataFrame
    #: The trigram index of the chunks; without it every search reads all chunks.
    postings: DataFrame | None = None
    #: symbols joined to references, where that comes without a join; whoever replaces one of them replaces this.
    joined: DataFrame | None = None
    #: (content_hash, namespace, names, words) with all names and references of a content in one row, where they come so;
    #: whoever replaces symbols or references replaces this.
    contents: DataFrame | None = None
    #: mapping with the texts of its chunks, where that comes without a join; whoever replaces one of them replaces this.
    places: DataFrame | None = None

    def occurrences(self) -> DataFrame:
        """Every symbol with each of its references."""
        return self.symbols.join(self.references, "symbol_id") if self.joined is None else self.joined

    def placed(self) -> DataFrame:
        """(content_hash, chunk_hash, chunk_index, text_content): every chunk at each of its places."""
        if self.places is not None:
            return self.places
        return self.mapping.select("content_hash", "chunk_hash", "chunk_index").join(self.chunks.select("chunk_hash", "text_content"), "chunk_hash")

    def write(self, path: str) -> None:
        """Parquet tables; files lie by repository so that repository filters prune partitions, symbols and references by
        a name's or a symbol's order so that row groups are skipped. The trigram index is made from the stored chunks."""
        for f in fields(self):
            if f.name not in ("postings", *DERIVED):
                rows = getattr(self, f.name)
                if f.name in ORDER:
                    rows = rows.repartitionByRange(*ORDER[f.name]).sortWithinPartitions(*ORDER[f.name])
                writer = rows.write.mode("overwrite")
                (writer.partitionBy("repository") if f.name == "files" else writer).parquet(f"{path}/{f.name}")
        write_postings(self.files.sparkSession.read.schema(SCHEMAS["chunks"]).parquet(f"{path}/chunks"), f"{path}/postings")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(**{f.name: spark.read.schema(SCHEMAS[f.name]).parquet(f"{path}/{f.name}") for f in fields(Index) if f.name not in DERIVED})


#: What a stored index doesn't have.
DERIVED = ("joined", "contents", "places")
ORDER = {"symbols": ["name_lc", "content_hash"], "references": ["symbol_id"]}
SCHEMAS = {
    "files": schema.FILES,
    "blobs": schema.CONTENT_BLOBS,
    "mapping": schema.CONTENT_BLOB_CHUNKS,
    "chunks": schema.CHUNKS,
    "symbols": schema.SYMBOLS,
    "namespaces": schema.SYMBOL_NAMESPACES,
    "references": schema.SYMBOL_REFERENCES,
    "branches": schema.BRANCHES,
    "live": schema.LIVE_BRANCHES,
    "snapshots": schema.BRANCH_SNAPSHOTS,
    "policies": schema.BRANCH_POLICIES,
    "snapshot_policies": schema.SNAPSHOT_POLICIES,
    "postings": "bucket int, gram int, chunk_id long",
}
