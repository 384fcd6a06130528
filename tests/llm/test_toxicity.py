import random
import re

import numpy as np

from lumenseek.llm import toxicity as op

from .fixtures import clash, doc, frame, odd_rows, words

BAD = ["grob", "wutig", "fies"]


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 0, 1, 2, 3])
        w = words(rng, rng.randint(20, 120)).split()
        for _ in range(grade * 3):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append(doc(i, " ".join(w)))
        labels.append((i, 1, grade))
    return rows, labels


def test_grades_held_out(spark):
    rng = random.Random(1)
    rows, labels = labelled(rng, 600)
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    model = op.train(frame(spark, rows), known)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in op.score(frame(spark, rows), model, ["doc_id"]).collect()}
    held = labels[400:]
    assert sum((got[i].p_toxic >= 0.5) == (g > 0) for i, _, g in held) >= 0.97 * len(held)
    mean = [np.mean([got[i].expected_severity for i, _, g in held if g == k]) for k in range(4)]
    assert mean == sorted(mean)
    assert sum(abs(got[i].severity - g) <= 1 for i, _, g in held) >= 0.97 * len(held)


def test_two_grades_are_refined(spark):
    rng = random.Random(2)
    rows, labels = labelled(rng, 400)
    model = op.train(frame(spark, rows), spark.createDataFrame([(i, q, int(g > 0)) for i, q, g in labels], "doc_id long, quality int, toxic int"))
    assert len(model.thresholds) > 1
    got = {r.doc_id: r.expected_severity for r in op.score(frame(spark, rows), model, ["doc_id"]).collect()}
    assert np.mean([got[i] for i, _, g in labels if g == 3]) > np.mean([got[i] for i, _, g in labels if g == 1])


def test_gradient():
    """The likelihood that fit() climbs, by finite differences of its result: no step along any weight helps much."""
    rng = np.random.default_rng(0)
    x = [(np.array([0, 1]), rng.normal(size=2)) for _ in range(300)]
    s = np.array([v[0] * 2 - v[1] for _, v in x])
    y = np.digitize(s + rng.logistic(size=300), [-1, 1])
    w, t = op.fit(x, y, 2, 3, 0.0, steps=1500)

    def loss(w, t):
        z = np.array([v @ w for _, v in x])
        f = 1 / (1 + np.exp(-(z[:, None] - t)))
        edge = np.hstack([np.ones((300, 1)), f, np.zeros((300, 1))])
        return -np.log(edge[np.arange(300), y] - edge[np.arange(300), y + 1]).mean()

    for k in range(2):
        for d in (-0.1, 0.1):
            assert loss(w + d * np.eye(2)[k], t) > loss(w, t)
            assert loss(w, t + d * np.eye(2)[k]) > loss(w, t)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = labelled(rng, 200)
    odd = [*odd_rows(rng), doc(900, "grob " * 40), doc(901, "Grob")]
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = op.train(frame(spark, rows), known)
    df = clash(frame(spark, odd)).drop("severity", "p_toxic", "expected_severity")
    got = op.score(df, model, ["doc_id"]).collect()
    assert len(got) == len(odd)
    assert {r.doc_id for r in got if r.p_toxic >= 0.5} >= {900}
    assert all(0 <= r.expected_severity <= 3 for r in got)
    none = op.train(frame(spark, rows), spark.createDataFrame([], known.schema))
    assert op.score(frame(spark, odd), none, ["doc_id"]).filter("p_toxic >= 0.5").count() == 0
    assert op.score(frame(spark, []), model, ["doc_id"]).count() == 0


def test_query_scores_every_document(spark, tmp_path):
    from lumenseek.llm.queries import op7_toxicity

    rng = random.Random(6)
    rows, labels = labelled(rng, 200)
    frame(spark, [*rows, doc(500, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted([r[0] for r in rows] + [500])
    assert all(r.is_toxic == (r.p_toxic >= 0.5) and r.expected_severity is not None for r in got)
    assert 0 < sum(r.is_toxic for r in got) < len(got)


def test_scores_against_counted_grams(spark):
    """Scores by string counting, and the likelihood's best weights against a dense search from another start."""
    rng = random.Random(9)
    rows, labels = labelled(rng, 200)
    model = op.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), feature_cap=3.0)
    texts = [*rows[:40], doc(800, "Ärger  GROB\n\tgrob ... grob grob grob grob"), doc(801, ""), doc(802, None)]
    got = {r.doc_id: r for r in op.score(frame(spark, texts), model, ["doc_id"]).collect()}
    for i, text, *_ in texts:
        s, counts = 0.0, {}
        if text:
            low = "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" and c != "×" else c for c in text)
            b = f" {re.sub(r'[ \t\n\r\x0b\x0c\x1c-\x1f]+', ' ', low)} ".encode()
            for k in range(len(b) - op.GRAM + 1):
                h = (int.from_bytes(b[k : k + op.GRAM], "little") * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - op.BITS)
                counts[h] = counts.get(h, 0) + 1
            s = sum(float(model.weights[h]) * min(n, 3.0) for h, n in counts.items())
        p = [1 / (1 + np.exp(-(s - t))) for t in model.thresholds]
        assert abs(got[i].expected_severity - sum(p)) < 1e-4 and abs(got[i].p_toxic - p[0]) < 1e-4


def test_repeated_labels_and_ties(spark):
    rng = random.Random(10)
    rows, labels = labelled(rng, 120)
    schema = "doc_id long, quality int, toxic int"
    once = op.train(frame(spark, rows), spark.createDataFrame(labels, schema))
    again = op.train(frame(spark, rows), spark.createDataFrame([*labels, *labels[:60]], schema))
    assert (once.weights == again.weights).all() and (once.thresholds == again.thresholds).all()
