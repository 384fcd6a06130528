import hashlib
import random

from lumenseek.llm import mixing as op

from .fixtures import clash, doc, frame, odd_rows, words


def brute(rows, weights, budget, seed=7):
    cum, queue = {}, []
    order = lambda d: (hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0)
    for d, text, _, source, _ in sorted(rows, key=lambda r: order(r[0])):
        n = len((text or "").split())
        w = weights.get(source, 1.0)
        if w > 0:
            cum[source] = cum.get(source, 0) + n
            queue.append((cum[source] / w, source, order(d), d, n))
    taken, total = [], 0
    for _, _, _, d, n in sorted(queue):
        if total + n > budget:
            break
        total += n
        taken.append((d, total))
    return taken


def corpus(rng, n):
    return [doc(i, words(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(n)]


def test_against_a_queue(spark, monkeypatch):
    rows = corpus(random.Random(1), 400)
    weights = {"a": 0.5, "b": 2.0}
    for per in (2000, 10):  # one range and many
        monkeypatch.setattr(op, "RANGE_ROWS", per)
        for budget in (0, 1, 3000, 10**9):
            want = brute(rows, weights, budget)
            got = [(r.doc_id, r.taken_tokens) for r in op.mixed(frame(spark, rows), weights, budget).collect()]
            assert got == want
            assert sorted(r.doc_id for r in op.mix_documents(frame(spark, rows), weights, budget).collect()) == sorted(d for d, _ in want)


def test_shares_near_the_weights(spark):
    rows = corpus(random.Random(2), 3000)
    got = op.mixed(frame(spark, rows), {"a": 1.0, "b": 2.0, "c": 3.0}, budget=10_000).groupBy("source").sum("tokens").collect()
    share = {r[0]: r[1] / 10_000 for r in got}
    assert abs(share["a"] - 1 / 6) < 0.02 and abs(share["b"] - 2 / 6) < 0.02 and abs(share["c"] - 3 / 6) < 0.02


def test_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    df = clash(frame(spark, rows))
    out = op.mix_documents(df, {"s": 1.0}, share=1.0)
    assert out.columns == df.columns
    assert out.count() == len(rows)
    assert op.mix_documents(df, {"s": 0.0}, share=1.0).count() == 2  # the null source's
    assert op.mix_documents(frame(spark, []), {}, share=0.5).count() == 0
    assert op.mixed(frame(spark, []), {}, share=0.5).count() == 0


def test_budget_among_copies(spark):
    rows = [doc(1, "one two three")] * 3 + [(1, "one two three", "de", "s", 9)] * 2
    df = frame(spark, rows)
    for budget, n in ((2, 0), (6, 2), (12, 4), (99, 5)):
        assert op.mixed(df, {}, budget).count() == n
        got = op.mix_documents(df, {}, budget).collect()
        assert len(got) == n
        assert sum(r.lang == "de" for r in got) == min(n, 2)  # by JSON "de" comes before "en"


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(op, "COPIES", 4)
    rows = [doc(1, "one two three")] * 30 + [doc(2, "four", "t"), doc(3, None), doc(4, "five six", None)]
    got = op.mixed(frame(spark, rows), {"s": 2.0}, 10**6).collect()
    assert [r.taken_tokens for r in got if r.doc_id == 1] == sorted(r.taken_tokens for r in got if r.doc_id == 1)
    assert len(got) == 33 and max(r.taken_tokens for r in got) == 93
    assert sorted(r.finish for r in got if r.doc_id == 1) == [1.5 * k for k in range(1, 31)]
