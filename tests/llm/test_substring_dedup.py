import random
from collections import defaultdict

from lumenseek.llm import substring_dedup as op

from .fixtures import clash, doc, frame, odd_rows, words


def corpus(rng):
    shared = [words(rng, n) for n in (50, 51, 70, 400)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randint(1, 80)) for _ in range(rng.randint(1, 3))]
        if i % 2:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        if i % 8 == 1:
            parts.append(rng.choice(shared))
        rows.append(doc(i, rng.choice([" ", "\n"]).join(parts)))
    rows.append(doc(40, rows[2][1]))
    return rows


def covered(rows):
    """{(doc, word)}: words in windows of 50 words that two documents have."""
    where = defaultdict(set)
    texts = {r[0]: r[1].split() for r in rows if r[1]}
    for d, w in texts.items():
        for i in range(len(w) - op.WINDOW + 1):
            where[tuple(w[i : i + op.WINDOW])].add((d, i))
    return {(d, i + k) for places in where.values() if len({d for d, _ in places}) > 1 for d, i in places for k in range(op.WINDOW)}


def test_against_all_windows(spark):
    rows = [r for r in corpus(random.Random(1))]
    texts = {r[0]: r[1] for r in rows}
    for size in (op.SHARD_BYTES, 2000):  # one shard and many
        got = op.occurrences(frame(spark, rows), size).collect()
        words_of, repeats = set(), set()
        for r in got:
            span = texts[r.doc_id][r.start : r.end]
            assert len(span.split()) >= op.WINDOW
            before = len(texts[r.doc_id][: r.start].split())
            own = {(r.doc_id, before + k) for k in range(len(span.split()))}
            words_of |= own
            repeats |= set() if r.is_first else own
        assert words_of == covered(rows)
        # without the repeats every window of words is still there once
        left = {texts[d].split()[k] for d, k in words_of - repeats}
        assert {texts[d].split()[k] for d, k in words_of} == left


def test_clean_documents_stay_out(spark):
    rng = random.Random(2)
    assert op.occurrences(frame(spark, [doc(i, words(rng, 200)) for i in range(20)])).count() == 0
    # 49 words in common are too few
    shared = words(rng, 49)
    assert op.occurrences(frame(spark, [doc(i, f"{words(rng, 30)} {shared} {words(rng, 30)}") for i in range(5)])).count() == 0


def test_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    got = op.occurrences(clash(frame(spark, rows))).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(6, 0, len(rows[5][1]))]
    assert op.occurrences(frame(spark, [])).count() == 0


def test_repeats_inside_one_document(spark):
    rng = random.Random(4)
    a, b, near = words(rng, 60), words(rng, 120), words(rng, 30)
    rows = [doc(1, f"{words(rng, 40)} {a} {words(rng, 30)} {a} {words(rng, 9)}"), doc(2, f"{b} {b}\n{words(rng, 200)} {b}"), doc(3, words(rng, 400)), doc(4, f"{near} {near} {words(rng, 100)}")]
    texts = {r[0]: r[1] for r in rows}
    for size in (op.SHARD_BYTES, 500):
        got = op.occurrences(frame(spark, rows), size).collect()
        assert {r.doc_id for r in got} == {1, 2}
        assert sorted(texts[1][r.start : r.end] for r in got if r.doc_id == 1) == [a, a]
        assert [(r.start, r.end) for r in got if r.doc_id == 1 and r.is_first] == [(texts[1].index(a), texts[1].index(a) + len(a))]
        assert {k for r in got if r.doc_id == 2 for k in range(r.start, r.end)} >= {i + k for i in (0, len(b) + 1, len(texts[2]) - len(b)) for k in range(len(b))}
        assert [(r.start, r.end) for r in got if r.doc_id == 2 and r.is_first] == [(0, len(b))]


def test_overlapping_repeats_leave_the_first(spark):
    rows = [doc(1, " ".join(["word"] * 120)), doc(2, " ".join(["junk"] * 99))]
    got = sorted((r.doc_id, r.is_first, r.start, r.end) for r in op.occurrences(frame(spark, rows)).collect())
    # 99 words have no two places that don't overlap
    assert got == [(1, False, 249, 599), (1, True, 0, 249)]


def test_keys_of_many_texts_in_several_parts(spark, monkeypatch):
    rows = corpus(random.Random(1))
    own = {tuple(r) for r in op.occurrences(frame(spark, rows)).collect()}
    monkeypatch.setattr(op, "WAY_ROWS", 7)
    assert {tuple(r) for r in op.occurrences(frame(spark, rows)).collect()} == own
