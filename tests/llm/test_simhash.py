import random

import numpy as np

from lumenseek.llm import simhash as op

from .fixtures import clash, doc, frame, odd_rows, words


def corpus(rng, n):
    rows = []
    for _ in range(n):
        text = words(rng, rng.randint(30, 200))
        rows.append(doc(len(rows), text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = text.split()
            for _ in range(max(1, len(w) // 20)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append(doc(len(rows), " ".join(w)))
    return rows


def groups(rows):
    data = np.frombuffer("".join(r[1] for r in rows).encode() + bytes(16), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r[1].encode()) for r in rows])])
    _, f = op.simhashes(data, int(at[-1]), at)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(f[i] ^ f[j]).sum() <= op.MOST_APART:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_against_all_pairs(spark):
    rows = corpus(random.Random(2), 150)
    want = {i: r for i, r in enumerate(groups(rows)) if r != i}
    got = {r.doc_id: r.kept_doc_id for r in op.near_duplicates(frame(spark, rows)).collect()}
    assert got.keys() <= want.keys()
    assert len(got) >= 0.97 * len(want) > 50
    assert op.dedup_documents(frame(spark, rows)).count() == len(rows) - len(got)


def test_split_buckets_keep_recall(spark, monkeypatch):
    rng = random.Random(4)
    rows = corpus(rng, 150)
    pair = [np.array([r]) for r in (0,)]
    assert pair
    # one sampled bit only and a small cap: every bucket is oversized
    monkeypatch.setattr(op, "CAP", 16)
    data = np.frombuffer("".join(r[1] for r in rows).encode() + bytes(16), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r[1].encode()) for r in rows])])
    _, f = op.simhashes(data, int(at[-1]), at)
    import pyarrow as pa

    edges = set()
    for t in range(op.TABLES):
        key = op.sampled(f, op.SAMPLES[t][:2]).view(np.int64) + t * 16
        table = np.column_stack([key, f.view(np.int64), np.arange(len(f))])
        out = op.bucket_pairs(pa.table({"data": [table.tobytes()]}))
        edges |= set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    found = {x for e in edges for x in e}
    near = {i for i in range(len(f)) for j in range(len(f)) if i != j and np.bitwise_count(f[i] ^ f[j]).sum() <= op.MOST_APART}
    assert found <= near
    assert len(found) >= 0.97 * len(near)


def test_odd_rows(spark):
    rows = odd_rows(random.Random(1))
    df = clash(frame(spark, rows))
    out = op.dedup_documents(df)
    assert out.columns == df.columns
    assert out.count() == len(rows) - 1
    assert op.near_duplicates(frame(spark, [])).count() == 0
    assert op.dedup_documents(frame(spark, [])).count() == 0


def test_first_doc_id_stays(spark):
    text = words(random.Random(9), 50)
    rows = [doc(7, text), doc(3, text.upper()), doc(5, text + "."), doc(9, words(random.Random(8), 50))]
    assert {(r.doc_id, r.kept_doc_id) for r in op.near_duplicates(frame(spark, rows)).collect()} == {(7, 3), (5, 3)}


def test_connecting_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (300, op.WORDS64), np.uint64)
    for i in range(20, 300):  # chains: each a few bits from one before
        f[i] = f[rng.integers(0, i)]
        for b in rng.permutation(op.BITS)[: rng.integers(20, 70)]:
            f[i, b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    root = np.arange(300)
    for i in range(300):
        for j in range(i):
            if np.bitwise_count(f[i] ^ f[j]).sum() <= op.MOST_APART:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    u, v = op.connecting(f)
    assert (np.bitwise_count(f[u] ^ f[v]).sum(axis=1) <= op.MOST_APART).all()
    nodes, roots = op.forest(u, v)
    got = np.arange(300)
    got[nodes] = roots
    assert (got == root).all()


def test_a_bucket_of_many_near_copies():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 20_000
    f = np.repeat(rng.integers(0, 1 << 63, (1, op.WORDS64), np.uint64), n, axis=0)
    for w in range(op.WORDS64):
        for _ in range(2):
            f[:, w] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    began = time.time()
    out = op.bucket_pairs(pa.table({"data": [np.column_stack([np.zeros(n, np.int64), f.view(np.int64), np.arange(n)]).tobytes()]}))
    assert out.num_rows == n - 1
    assert time.time() - began < 60


def test_ways_to_split_find_pairs_at_the_limit():
    for more in (1, 4, 8):
        meet = 1 - (1 - (1 - op.MOST_APART / op.BITS) ** more) ** op.split_ways(more)
        assert meet >= op.SPLIT_RECALL


def test_string_ids(spark):
    text = words(random.Random(9), 50)
    df = spark.createDataFrame([("b", text), ("a", text + "."), ("c", None)], "doc_id string, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in op.near_duplicates(df).collect()] == [("b", "a")]
