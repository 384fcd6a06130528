import math
import random
from collections import Counter

import pytest

from lumenseek.llm import lm_score as op

from .fixtures import clash, doc, frame, odd_rows, words


def brute(texts):
    """Code lengths by recursion over dictionaries."""
    n = Counter()
    for t in texts:
        b = bytes(op.DEPTH) + t
        for i in range(op.DEPTH, len(b)):
            for j in range(8):
                node = (1 << j) | (b[i] >> (8 - j))
                bit = (b[i] >> (7 - j)) & 1
                for d in range(op.DEPTH + 1):
                    n[(b[i - d : i], node, bit)] += 1
    children = {}
    for c, node, _ in n:
        if c:
            children.setdefault((c[1:], node), set()).add((c, node))

    def kt(k):
        a, b = n[(*k, 0)], n[(*k, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    known = {}

    def log_w(k):
        if k not in known:
            if len(k[0]) == op.DEPTH:
                known[k] = kt(k)
            else:
                x, y = kt(k), sum(log_w(c) for c in children[k])
                m = max(x, y)
                known[k] = math.log(0.5) + m + math.log(math.exp(x - m) + math.exp(y - m))
        return known[k]

    def one(context, node, d):
        k = (context[len(context) - d :], node)
        a, b = n[(*k, 0)], n[(*k, 1)]
        own = (b + 0.5) / (a + b + 1)
        if d == op.DEPTH:
            return own
        w = math.exp(math.log(0.5) + kt(k) - log_w(k))
        return w * own + (1 - w) * one(context, node, d + 1)

    out = []
    for t in texts:
        b, bits = bytes(op.DEPTH) + t, 0.0
        for i in range(op.DEPTH, len(b)):
            for j in range(8):
                p = one(b[i - op.DEPTH : i], (1 << j) | (b[i] >> (8 - j)), 0)
                bits -= math.log2(p if (b[i] >> (7 - j)) & 1 else 1 - p)
        out.append(bits)
    return out


def test_against_recursion(spark):
    rng = random.Random(1)
    vocabulary = [words(rng, 1) for _ in range(20)] + ["é", "日本"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    want = brute([t.encode() for t in texts])
    df = frame(spark, [doc(i, t) for i, t in enumerate(texts)])
    for shard in (10**9, 200):  # one shard and many
        got = {r.doc_id: r for r in op.score(df, shard).collect()}
        for i, t in enumerate(texts):
            assert got[i].n_bytes == len(t.encode())
            assert got[i].bits == pytest.approx(want[i], rel=1e-5)
            assert got[i].bits_per_byte == pytest.approx(want[i] / len(t.encode()), rel=1e-5)


def test_odd_rows(spark):
    rows = odd_rows(random.Random(2))
    for shard in (10**9, 2000):
        got = op.score(clash(frame(spark, rows)), shard).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert by[1].bits_per_byte is None and by[1].n_bytes == 0
        assert by[2].bits_per_byte is None
        assert 0 < by[5].bits_per_byte < 0.1  # 200,000 times the same letter
        assert sum(r.doc_id == 6 for r in got) == 2 and by[6].bits_per_byte > 0.5
    assert op.score(frame(spark, [])).count() == 0


def test_large_counts_agree_with_lgamma():
    import numpy as np

    n = np.array([0, 1, 5, 1999, 2000, 2001, 4000, 4001, 10**6])
    assert op._log_half(n) == pytest.approx([math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n], rel=1e-9)
    assert op._log_factorial(n) == pytest.approx([math.lgamma(x + 1) for x in n], rel=1e-9, abs=1e-12)
