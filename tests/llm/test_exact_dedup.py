import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from lumenseek.llm import exact_dedup as op

from .fixtures import clash, doc, frame, odd_rows, words


@given(st.sets(st.integers(0, 2**40 - 1), max_size=300), st.integers(40, 60))
def test_golomb_round_trip(values, bits):
    x = np.array(sorted(values), np.uint64)
    assert np.array_equal(op.golomb_decode(op.golomb_encode(x, 1 << bits), len(x)), x)


def test_golomb_is_small():
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 26, 4000, dtype=np.uint64))
    assert len(op.golomb_encode(x, 1 << 26)) * 8 / len(x) < np.log2((1 << 26) / len(x)) + 2


def brute(rows):
    kept, out = {}, []
    for d, t in sorted(((r[0], r[1]) for r in rows if r[1] is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        if t in kept:
            out.append((d, kept[t]))
        else:
            kept[t] = d
    return sorted(out)


def test_against_a_dictionary(spark, monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 30)) for _ in range(300)]
    rows = [doc(i, rng.choice(texts)) for i in range(700)]
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(op, "CHUNK", chunk)
        got = op.duplicates(frame(spark, rows).repartition(5))
        assert sorted((r.doc_id, r.kept_doc_id) for r in got.collect()) == brute(rows)


def test_odd_rows(spark):
    rows = [*odd_rows(random.Random(2)), doc(11, ""), doc(12, "é"), doc(13, "é")]
    got = op.duplicates(clash(frame(spark, rows)))
    assert sorted((r.doc_id, r.kept_doc_id) for r in got.collect()) == [(6, 6), (11, 2)]
    assert op.duplicates(frame(spark, [])).count() == 0
