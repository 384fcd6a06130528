"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of doc_id); a document's virtual finish time is its source's cumulative
tokens up to and with it, divided by the source's target weight. In the order of finish time documents are taken till
the next one would pass the total budget.

Cumulative sums over any number of rows: rows are grouped in ranges of the order, range totals get a running sum, and a
window inside each range adds the rest, so that a hot source isn't one task; a row that is repeated is one until its
copies get their places, so a hot row isn't one task either.

Defined cases: a null or empty text has 0 tokens, a very long one counts whole; a null source is a source of its own; ties
of finish time go by source, shuffle hash, doc_id, text hash (nulls first); sources without a weight get default_weight; a
source of weight 0 is never taken; repeated rows count each, and where the budget ends among copies of one row only as many
are taken as fit (those that differ in other columns in the order of their JSON); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, sized, written

#: Rows that a range of a source's shuffled order should have about, and of the schedule.
RANGE_ROWS, TAKE_ROWS = 2000, 100_000
#: Copies of a repeated row that one task numbers.
COPIES = 100_000


def tokens(text: Column) -> Column:
    """Words apart by single blanks, tabs and newlines, as a count that SQL has too."""
    squeezed = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(text.isNull() | (squeezed == ""), F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def shuffle_hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def tokenised(docs: DataFrame, seed: int = 7) -> DataFrame:
    """What the schedule needs of each row: (doc_id, source, tokens, h, th)."""
    return docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), shuffle_hash(seed).alias("h"), F.xxhash64("text").alias("th"))


def schedule(rows: DataFrame, weights: dict[str, float], default_weight: float = 1.0) -> DataFrame:
    """tokenised rows of sources of positive weight, with their virtual finish time; copy and copies number repeated rows."""
    same = ["source", "h", "doc_id", "th", "tokens"]
    rows = written(rows.groupBy(*same).agg(F.count("*").alias("copies")))
    n, most = rows.agg(F.count("*"), F.max("copies")).first()
    digits = max(1, min(6, len(f"{max(1, n // RANGE_ROWS):x}")))  # 16**digits ranges a source
    rows = rows.withColumn("range", F.substring("h", 1, digits)).withColumn("own", F.col("tokens") * F.col("copies"))
    ahead = rows.groupBy("source", "range").agg(F.sum("own").alias("own"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select(F.col("source").alias("s_"), F.col("range").alias("r_"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    cum = rows.withColumn("inside", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    cum = cum.join(ahead, F.col("source").eqNullSafe(F.col("s_")) & (F.col("range") == F.col("r_")))
    weight = F.lit(float(default_weight))
    for s, w in sorted(weights.items()):
        weight = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(weight)
    cum = cum.withColumn("weight", weight).filter("weight > 0")
    cum = cum.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / COPIES) - 1)))
    if (most or 0) > COPIES:
        cum = cum.repartition("h", "chunk")
    cum = cum.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES + 1, F.least((F.col("chunk") + 1) * COPIES, F.col("copies")))))
    return cum.select("doc_id", "source", "tokens", "h", "th", "copy", "copies", ((F.col("inside") + F.col("ahead") + F.col("tokens") * F.col("copy")) / F.col("weight")).alias("finish"))


ORDER = ["finish", "source", "h", "doc_id", "th", "copy"]


def mixed(docs: DataFrame, weights: dict[str, float], budget: int | None = None, share: float | None = None, seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """(doc_id, source, tokens, finish, taken_tokens, h, th, copy, copies) of the rows taken, range-sorted by finish time;
    taken_tokens is the running total. The budget is in tokens, or a share of all tokens, rounded down."""
    rows = written(tokenised(docs, seed))
    if budget is None:
        budget = int((rows.agg(F.sum("tokens")).first()[0] or 0) * share)
    timed = written(schedule(rows, weights, default_weight))
    discard(rows)
    ranges = max(1, -(-timed.count() // TAKE_ROWS))
    # the ranges hold alike many rows, however the weights stretch the axis, and are few enough for one task to add up
    rows = written(timed.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id()))
    discard(timed)
    ahead = rows.groupBy("range").agg(F.sum("tokens").alias("own"))
    ahead = ahead.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")).filter(F.col("ahead") <= budget)
    inside = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sized(ahead, ranges), "range").withColumn("taken_tokens", F.col("ahead") + F.sum("tokens").over(inside))
    return out.filter(F.col("taken_tokens") <= budget).select("doc_id", "source", "tokens", "finish", "taken_tokens", "h", "th", "copy", "copies").orderBy(*ORDER)


def mix_documents(docs: DataFrame, weights: dict[str, float], budget: int | None = None, share: float | None = None, seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """The rows of docs that are taken. Of each source that is a prefix of its shuffled order, so only each source's last
    taken row has to reach the rows' scan, not the list of all that are taken."""
    chosen = mixed(docs, weights, budget, share, seed, default_weight)
    last = written(chosen.groupBy("source").agg(F.max(F.struct("h", "doc_id", "th", "copy", "copies")).alias("last")))
    source, edge, room, whole = fresh(docs, "last_source", "edge", "room", "whole")
    bound = last.select(F.col("source").alias(source), F.struct("last.h", "last.doc_id", "last.th").alias(edge), F.col("last.copy").alias(room), (F.col("last.copy") == F.col("last.copies")).alias(whole))
    place = F.struct(shuffle_hash(seed).alias("h"), F.col("doc_id"), F.xxhash64("text").alias("th"))
    placed = docs.join(sized(bound), F.col("source").eqNullSafe(F.col(source)))
    taken = placed.filter((place < F.col(edge)) | ((place == F.col(edge)) & F.col(whole))).drop(source, edge, room, whole)
    if last.filter("last.copy < last.copies").isEmpty():
        return taken
    # copies of the row at the budget's edge: alike ones are one until so many of them are taken
    row, json, n, before = fresh(docs, "row", "json", "n", "before")
    same = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    alike = placed.filter((place == F.col(edge)) & ~F.col(whole)).groupBy(F.col(source), F.to_json(same).alias(json)).agg(F.first(same).alias(row), F.first(room).alias(room), F.count("*").alias(n))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy(source).orderBy(json).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = alike.withColumn(n, F.least(F.col(n), F.col(room) - ahead)).filter(F.col(n) > 0)
    return taken.unionByName(some.select(F.explode(F.array_repeat(row, F.col(n).cast("int"))).alias(row)).select(f"{row}.*"))
