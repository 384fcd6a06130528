"""Toxicity: cumulative-link (proportional-odds) regression on sparse text features.

P(severity > j) = sigmoid(w.x - t_j): one weight vector for all grades and ordered thresholds t_0 < t_1 < ...
x counts hashed byte 5-grams of the case-folded text with runs of blanks as one blank, so beginnings of words count. A
count beyond feature_cap counts as feature_cap, so that one repeated word doesn't settle a text: that is the feature map,
the same in training and scoring, and every text is read whole.

Defined cases: a null or empty text has no features and the score 0; rows that come more than once are scored each; labels
that repeat a doc_id count once, with the highest grade; documents that repeat a doc_id are all fit on; labels with nulls
don't count; features equally odd go by number; an empty table gives no rows; without labelled rows of both kinds nothing
can be learned: a warning is given and every row has the least grade; extra columns don't matter, keys named like results
need other names for these.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, blocks, bounded, folded, lean, text_buffers, u64_at, written

BITS, GRAM = 20, 5
TO_BLANK = np.where(SPACE, 32, np.arange(256)).astype(np.uint8)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32, 2**BITS
    thresholds: np.ndarray  # rising
    feature_cap: float

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(severity > j) for each j, one row a score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashed 5-grams, their rows' offsets) for blocks of rows."""
    for i, j in blocks(offsets, 1 << 20):
        lo, hi = int(offsets[i]), int(offsets[j])
        raw = TO_BLANK[folded(np.append(data[lo:hi], np.uint8(0)))[:-1]]
        starts = offsets[i : j + 1] - lo
        keep = np.ones(hi - lo, bool)
        if hi - lo > 1:
            keep[1:] = ~((raw[1:] == 32) & (raw[:-1] == 32))
        kept = np.concatenate([[0], np.cumsum(keep)])
        rows = kept[starts]
        text = raw[keep]
        # each row between blanks, so that its first and last words have edges, and five zeros at the end
        n = j - i
        buf = np.full(len(text) + 2 * n + 16, 32, np.uint8)
        at = np.arange(len(text)) + 2 * np.repeat(np.arange(n), np.diff(rows)) + 1
        buf[at] = text
        outer = rows + 2 * np.arange(n + 1)
        v = u64_at(buf)[: outer[-1]] & np.uint64((1 << (8 * GRAM)) - 1)
        h = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        # a gram that reaches into the next row isn't counted
        inside = np.ones(len(h), bool)
        for k in range(1, GRAM):
            inside[np.maximum(outer[1:] - k, outer[:-1])] = False
        yield i, j, np.where(inside, h, -1), outer


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows of severity 0 that have it, other rows that have it) of a partition."""
    have = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        toxic = np.asarray(batch.column("severity")) > 0
        for i, j, h, outer in grams(data, offsets):
            for r in range(i, j):
                own = h[outer[r - i] : outer[r - i + 1]]
                have[int(toxic[r])][np.unique(own[own >= 0])] += 1
    at = np.flatnonzero(have.any(axis=0))
    for k in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000].astype(np.int32)), pa.array(have[0][at[k : k + 50_000]]), pa.array(have[1][at[k : k + 50_000]])], ["feature", "clean", "toxic"])


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_features: int, grades: int, l2: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the mean likelihood; thresholds are the first plus sums of exponentials."""
    rows = np.concatenate([np.full(len(c), r) for r, (c, _) in enumerate(x)]) if x else np.zeros(0, int)
    cols = np.concatenate([c for c, _ in x]) if x else np.zeros(0, int)
    vals = np.concatenate([v for _, v in x]) if x else np.zeros(0)
    share = np.bincount(y, minlength=grades) / len(y)
    up = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    t = -np.log(up / (1 - up))
    gaps = np.log(np.maximum(np.diff(t), 1e-2))
    p = np.concatenate([np.zeros(n_features), [t[0]], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(y)
    for k in range(1, steps + 1):
        w, t = p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
        s = np.bincount(rows, weights=w[cols] * vals, minlength=n)
        f = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -40, 40)))  # P(y > j)
        edge = np.hstack([np.ones((n, 1)), f, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), f * (1 - f), np.zeros((n, 1))])
        i = np.arange(n)
        prob = np.maximum(edge[i, y] - edge[i, y + 1], 1e-9)
        ds = -(slope[i, y] - slope[i, y + 1]) / prob / n
        dt = np.zeros(len(t))
        np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, slope[i, y] / prob / n, 0))
        np.add.at(dt, np.minimum(y, len(t) - 1), np.where(y < len(t), -slope[i, y + 1] / prob / n, 0))
        g = np.concatenate([np.bincount(cols, weights=ds[rows] * vals, minlength=n_features) + l2 * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, features: int = 2048, l2: float = 1e-4, severity_grades: int = 3, feature_cap: float = 4.0, least_rows: int = 3) -> OrdinalModel:
    """Fit on at most max_labelled labelled rows (a documented bound): half toxic, half clean, in the order of a hash of doc_id.

    labels(doc_id, toxic): toxic may hold any whole grades from 0. Where it holds only 0 and 1, toxic rows are graded
    1..severity_grades by the part of their grams that are toxic-class features (equal shares of the rows), as the table has
    no finer grade. Features: those most unlike in document frequency between clean and toxic rows, among those that
    least_rows of the labelled rows have at least. Rows with a null label, id or text don't count.
    """
    bounded(docs.sparkSession)
    half = max_labelled // 2
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("severity")).filter("doc_id is not null and severity is not null and severity >= 0").groupBy("doc_id").agg(F.max("severity").alias("severity"))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    some = written(known.filter("severity = 0").orderBy(order, "doc_id").limit(half).unionByName(known.filter("severity > 0").orderBy(order, "doc_id").limit(half)))
    rows = written(docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id"))
    got = rows.mapInArrow(lean(_sample_counts), "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {bool(r[0]): r[1] for r in rows.groupBy(F.col("severity") > 0).count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        warnings.warn("no labelled rows of both kinds: toxicity can't be told", stacklevel=2)
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.array([30.0, 31.0, 32.0][:severity_grades]), 0)
    pc, pt = F.col("clean") / F.lit(n0), F.col("toxic") / F.lit(n1)
    odd = F.abs(pt - pc) / F.sqrt((pc + pt) * (2 - pc - pt) / 4 + F.lit(1.0 / (n0 + n1)))
    best = got.filter(F.col("clean") + F.col("toxic") >= least_rows).withColumn("odd", odd).orderBy(F.desc("odd"), "feature").limit(features).select("feature", (pt > 3 * pc).alias("sign")).collect()
    column = np.full(1 << BITS, -1, np.int32)
    column[[r.feature for r in best]] = np.arange(len(best))
    towards = np.array([bool(r.sign) for r in best] or [False])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            cols, counts, sizes = [], [], []
            for i, j, h, outer in grams(data, offsets):
                for r in range(i, j):
                    own = h[outer[r - i] : outer[r - i + 1]]
                    own = column[own[own >= 0]]
                    sizes.append(len(own))
                    c, k = np.unique(own[own >= 0], return_counts=True)
                    cols.append(c.astype(np.int32))
                    counts.append(k.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("severity"), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], ["doc_id", "severity", "cols", "counts", "size"])

    table = sorted(rows.mapInArrow(lean(vectors), f"doc_id {dict(rows.dtypes)['doc_id']}, severity int, cols array<int>, counts array<int>, size long").collect(), key=lambda r: (r.doc_id, r.size, r.cols))
    x = [(np.array(r.cols, int), np.array(r.counts, float)) for r in table]
    y = np.array([r.severity for r in table])
    if y.max() == 1 and severity_grades > 1:
        hits = np.array([v[towards[c]].sum() / max(r.size, 1) for (c, v), r in zip(x, table, strict=True)])
        y = np.where(y > 0, 1 + np.searchsorted(np.quantile(hits[y > 0], np.arange(1, severity_grades) / severity_grades), hits, "left"), 0)
        y = np.unique(y, return_inverse=True)[1]  # no grade without rows
    w, t = fit([(c, np.minimum(v, feature_cap)) for c, v in x], y, len(best), int(y.max()) + 1, l2)
    # half of the sample is toxic, as the thresholds expect; nothing is known of the rate elsewhere
    weights = np.zeros(1 << BITS, np.float32)
    weights[[r.feature for r in best]] = w
    return OrdinalModel(weights, t, feature_cap)


def score(docs: DataFrame, model: OrdinalModel, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """keys, expected_severity (sum over j of P(severity > j)), p_toxic (P(severity > 0)), severity (most likely grade's
    index: thresholds whose probability is at least a half). A null or empty text has no features: its score is 0.
    Every text is read whole. names: other names for the three columns, for keys that clash with them."""
    names = names or ["expected_severity", "p_toxic", "severity"]
    where = len(keys) if "text" not in keys else keys.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the corpus
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wide = np.append(m.weights, np.float32(0))
        used = wide != 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(where))
            s = np.zeros(len(batch))
            for i, j, h, outer in grams(data, offsets):
                at = np.flatnonzero(used[h])
                f = h[at].astype(np.int64)
                row = np.searchsorted(outer, at, "right") - 1
                pair, count = np.unique((row.astype(np.int64) << BITS) | f, return_counts=True)
                s[i:j] = np.bincount(pair >> BITS, weights=wide[pair & ((1 << BITS) - 1)] * np.minimum(count, m.feature_cap), minlength=j - i)
            p = m.above(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], [*keys, *names])

    bounded(docs.sparkSession)
    used_columns = docs.select(*(f"`{k}`" for k in keys), *(["text"] if "text" not in keys else []))
    added = zip(names, (T.DoubleType(), T.DoubleType(), T.IntegerType()), strict=True)
    return used_columns.mapInArrow(lean(run), T.StructType([*used_columns.schema.fields[:n], *(T.StructField(k, t) for k, t in added)]))
