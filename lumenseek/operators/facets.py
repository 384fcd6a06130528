"""Counts beside a page of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import directory, extension_facet

TOP = 8
TOP_TYPES = 10


def facet(rows: DataFrame, value: Column, top: int = TOP) -> DataFrame:
    """(value, count) of the most frequent values; ties by lower case, then by value."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.lower("value"), "value").limit(top)


def directories(rows: DataFrame) -> DataFrame:
    return facet(rows, directory(F.col("file_path")))


def repositories(rows: DataFrame) -> DataFrame:
    return facet(rows, F.col("repository"))


def branches(rows: DataFrame) -> DataFrame:
    """A row counts once for each of its branches."""
    return facet(rows.select(F.explode(F.array_distinct("branches")).alias("b")), F.col("b"))


def file_types(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(extension_facet(F.col("file_path")).alias("value")).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), "value").limit(TOP_TYPES)


def freshness(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("snapshot_indexed_at").alias("indexed_at"))
