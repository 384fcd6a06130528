"""Each stage of the pipeline against its own brute-force version, on what its predecessor kept."""

import random

import pytest

import corpus_pipeline
from lumenseek.llm.queries import SHARE, WEIGHTS, tokenizer_path

from . import test_line_dedup, test_mixing, test_simhash
from .fixtures import DOCS, clash, doc, frame, odd_rows, words

BAD = ["grob", "wutig", "fies", "boshaft"]


def corpus(rng):
    rows, labels = [], []
    for i in range(240):
        w = words(rng, rng.randint(30, 90)).split()
        if toxic := i % 4 == 0:
            for _ in range(8):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append(doc(i, " ".join(w), f"src{i % 4}"))
        if i < 160:
            labels.append((i, 1, int(toxic)))
    line = words(rng, 20)
    for i in (241, 242):
        rows.append(doc(i, f"{line}\n{words(rng, 60)}", "src1"))
    clean = rows[201][1].split()
    clean[5] = "andere"
    rows.append(doc(243, " ".join(clean), "src2"))  # a near copy of a clean document, too unlike for the line stage or not
    rows += [doc(244, None), doc(245, ""), doc(None, words(rng, 40), None)]
    return rows, labels


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus(random.Random(4))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = [rows]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        kept.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    return folder, kept


def test_toxic_documents_go_and_clean_ones_stay(made):
    before, after = made[1][0], {r[0] for r in made[1][1]}
    toxic = {r[0] for r in before if r[0] is not None and r[0] < 240 and r[0] % 4 == 0}
    assert len(toxic - after) >= 0.95 * len(toxic)
    clean = {r[0] for r in before} - toxic
    assert len(clean & after) >= 0.98 * len(clean)
    assert {244, 245, None} <= after


def test_lines(made):
    before, after = made[1][1], {r[0]: r[1] for r in made[1][2]}
    gone = test_line_dedup.brute([(-1 if r[0] is None else r[0], r[1]) for r in before])
    for d, text in ((r[0], r[1]) for r in before):
        if text is None or not text.strip():
            assert after[d] == text
            continue
        left = [x for n, x in enumerate(text.split("\n")) if (-1 if d is None else d, n) not in gone]
        assert after.get(d) == ("\n".join(left) if any(x.strip() for x in left) else None)


def test_near_copies(made):
    before = sorted((r for r in made[1][2] if r[1] and r[1].strip()), key=lambda r: (r[0] is not None, r[0] or 0))
    roots = test_simhash.groups(before)
    want = {before[i][0] for i, r in enumerate(roots) if r == i}
    after = {r[0] for r in made[1][3]}
    assert after - {244, 245} == want
    assert {244, 245} <= after


def test_mixture(made):
    before, after = made[1][3], {r[0] for r in made[1][4]}
    budget = int(sum(len((r[1] or "").split()) for r in before) * SHARE)
    want = {d for d, _ in test_mixing.brute([(r[0], r[1], r[2], r[3] or "", r[4]) for r in before], WEIGHTS, budget)}
    # documents without words take no room: whether those at the very end are in is a matter of ties
    empty = {r[0] for r in before if not (r[1] or "").split()}
    assert after - empty == want - empty


def test_ids(made):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = {r[0]: r[1] for r in made[1][4]}
    assert len(made[1][5]) == len(texts)
    for d, ids, n, back in made[1][5]:
        if texts[d] is None:
            assert ids is None and n is None and back is None
        else:
            assert ids == t.encode(texts[d], add_special_tokens=False).ids and n == len(ids) and back


def test_run_gives_the_last_stage(spark, made):
    folder, kept = made
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=key) == sorted(kept[5], key=key)


def test_odd_documents(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = corpus(rng)
    rows, labels = rows[8:120] + odd_rows(rng), labels[8:]  # ids of their own
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clash(frame(spark, rows))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 2:
            kept = [r.doc_id for r in docs.collect()]
            assert kept.count(6) <= 1 and {1, 2, 7} <= set(kept)  # the repeated row once; null, empty and blank ones stay
    assert all(r.round_trip in (True, None) for r in docs.collect())
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
