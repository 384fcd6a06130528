import random

import pytest

from lumenseek.llm import bpe
from lumenseek.llm.queries import tokenizer_path

from .fixtures import clash, doc, frame, odd_rows, words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(spark, library):
    rng = random.Random(1)
    alphabet = "abcdest're've'll  \n\t\r'éÉ日本😀123٣ .,!#--aaaa　\xa0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["", "'s", "it's 're'd ''s 'S", "a" * 50_000, "ab" * 30_000, words(rng, 2000), "<|endoftext|>", "\n\n a", "  "]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, [doc(i, t) for i, t in enumerate(texts)]), tokenizer_path(), ["doc_id"]).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert got[i].token_ids == e.ids, texts[i][:50]
        assert got[i].n_tokens == len(e.ids)
        assert got[i].round_trip


def test_decoding_gives_the_text_back(spark):
    rows = odd_rows(random.Random(2))
    df = clash(frame(spark, rows)).drop("token_ids", "n_tokens")
    ids = bpe.encode(df, tokenizer_path(), ["doc_id"])
    assert sorted(map(str, (r.text for r in bpe.decode(ids, tokenizer_path(), ["doc_id"]).collect()))) == sorted(str(r[1]) for r in rows)
    by = {(r.doc_id, r.n_tokens) for r in ids.collect()}
    assert {(1, None), (2, 0)} <= by


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), tokenizer_path(), ["doc_id"]).count() == 0


def test_queue_order():
    import numpy as np

    q = bpe.RankQueue()
    rng = random.Random(3)
    ranks = [rng.randrange(260_000) for _ in range(3000)]
    for r in ranks:
        q.push(r, np.array([r]))
    out = []
    while (top := q.pop()) is not None:
        out += [top[0]] * len(top[1])
    assert out == sorted(ranks)
