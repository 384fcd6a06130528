import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenseek.llm import ann as op


def brute(ids, x, top):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: set(ids[np.argsort(-row)[:top]].tolist()) for i, row in zip(ids, s, strict=True)}


@pytest.mark.parametrize("block", [4096, 300])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    x = np.vstack([centres[rng.integers(0, 12, 500)] + 0.1 * rng.normal(size=(500, 64)), rng.normal(size=(500, 64))]).astype(np.float32)
    ids = np.arange(1000) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = op.neighbours(df).collect()
    want = brute(ids, x, 10)
    assert len(got) == 10 * len(ids)
    assert sum(r.neighbour_id in want[r.vec_id] for r in got) / len(got) >= 0.9
    unit = {int(i): v / np.linalg.norm(v) for i, v in zip(ids, x, strict=True)}
    assert all(abs(r.similarity - unit[r.vec_id] @ unit[r.neighbour_id]) < 1e-5 for r in got)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(5)]
    rows += [(10, None), (None, rows[0][1]), (11, [0.0] * 8), (12, [1.0, 2.0]), (13, [None] + [1.0] * 7), (14, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS block", "1 AS rank")
    got = op.neighbours(df).collect()
    assert {r.vec_id for r in got} == set(range(5))
    assert all(sum(r.vec_id == i for r in got) == 4 for i in range(5))
    assert op.neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 40])
def test_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(0, 60, 3) for _ in range(12)]
    schema = "vec_id long, embedding array<float>"
    once, twice, several = ({v: {} for v in range(60)} for _ in range(3))
    for out, own in ((once, rows), (twice, rows + rows + rows[:20]), (several, rows + other)):
        for r in op.neighbours(spark.createDataFrame(own, schema)).collect():
            out[r.vec_id][r.rank] = (r.neighbour_id, round(r.similarity, 4))
    assert twice == once
    vectors = [np.array([v for j, v in rows + other if j == i]) for i in range(60)]
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in vectors]
    for i in range(60):
        got = [several[i][k][0] for k in range(1, 11)]
        assert len(set(got)) == 10 and i not in got
        best = np.array([-9 if j == i else (unit[i] @ unit[j].T).max() for j in range(60)])
        assert len(set(got) & set(np.argsort(-best)[:10].tolist())) >= 8


def test_footrule_order_against_all_pairs(spark, monkeypatch):
    """Candidates by the footrule's definition, and the queries that have too few of them by all rows."""
    monkeypatch.setattr(op, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[100] + 0.2 * rng.normal(size=(60, 16)).astype(np.float32)
    ids = np.arange(300) * 2
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    m, prefix, cut = 40, 8, 30
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = {int(i): None for i in ids}
    sample = np.array([r.embedding for r in df.selectExpr("*", "xxhash64(vec_id, 5) AS h").orderBy("h", "vec_id").collect()], np.float32)
    pivots = op.spread_pivots(sample / np.linalg.norm(sample, axis=1, keepdims=True), m)
    for i, near in zip(ids, op.orders(unit, pivots, prefix), strict=True):
        order[int(i)] = near.tolist()

    def footrule(a, b):
        return sum(abs((a.index(p) if p in a else prefix) - (b.index(p) if p in b else prefix)) for p in {*a, *b})

    got = {}
    for r in op.neighbours(df, pivots=m, prefix=prefix, cut=cut, sample=300, queries=F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.similarity)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    exact = 0
    for i, own in got.items():
        cand = [int(j) for j in ids if j != i and footrule(order[i], order[int(j)]) <= cut]
        if len(cand) < 10:
            cand, exact = [int(j) for j in ids if j != i], exact + 1
        sims = {j: float(unit[i // 2] @ unit[j // 2]) for j in cand}
        want = sorted(sims, key=lambda j: (-sims[j], j))[:10]
        assert all(abs(sims[want[k - 1]] - own[k][1]) < 1e-5 and own[k][0] in sims for k in range(1, 11))
    assert 0 < exact < len(got)


def test_string_ids(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"v{i:02}", rng.normal(size=8).tolist()) for i in range(20)], "vec_id string, embedding array<float>")
    got = op.neighbours(df, top=3).collect()
    assert len(got) == 60 and {r.vec_id for r in got} == {f"v{i:02}" for i in range(20)}
    assert all(r.neighbour_id != r.vec_id for r in got)
