import random

import numpy as np
import pyarrow as pa

from lumenseek.llm import line_dedup as op
from lumenseek.llm.common import padded, text_buffers

from .fixtures import clash, doc, frame, odd_rows, words


def grams(line):
    return {line[i : i + op.SHINGLE] for i in range(len(line) - op.SHINGLE + 1)} or {line}


def brute(rows):
    """{(doc, line): kept place} by comparing all pairs of lines."""
    places = sorted((d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if line.strip())
    sets = [grams(p[2]) for p in places]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if places[i][2] == places[j][2] or min(len(places[i][2]), len(places[j][2])) >= op.SHINGLE and both >= op.THRESHOLD * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {places[i][:2]: places[find(i)][:2] for i in range(len(places)) if find(i) != i}


def corpus(rng, n):
    lines = [words(rng, rng.randint(3, 40)) for _ in range(n)]
    rows = []
    for d in range(n):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(lines)
            if rng.random() < 0.5:
                w = line.split()
                w[rng.randrange(len(w))] = "changed"
                line = " ".join(w)
            own.append(line)
        rows.append(doc(d, "\n".join(own)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus(random.Random(3), 60)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in op.duplicate_lines(frame(spark, rows)).collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert got.keys() <= want.keys()
    assert len(got) >= 0.97 * len(want)
    assert sum(want[k] == v for k, v in got.items()) >= 0.97 * len(want)


def test_odd_rows(spark):
    rows = odd_rows(random.Random(1))
    df = clash(frame(spark, rows))
    out = op.dedup_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    # the repeated row stays once; null, empty and blank texts stay as they are
    assert len(got) == len(rows) - 1
    assert {r.text for r in got} == {r[1] for r in rows}


def test_first_place_stays_and_copies_go(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 20) for _ in range(3))
    rows = [doc(3, f"{a}\n{b}"), doc(1, f"{a}\n\n{c}"), doc(2, f"{c}\n{a}"), doc(4, "tiny\ntiny")]
    got = {r.doc_id: (r.text, r.n_chars) for r in op.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (f"{a}\n\n{c}", len(a) + len(c) + 2), 3: (b, len(b)), 4: ("tiny", 4)}


def test_empty_table(spark):
    assert op.dedup_lines(frame(spark, [])).count() == 0
    assert op.duplicate_lines(frame(spark, [])).count() == 0


def test_pairs_by_sets_and_sketches():
    """Packed shingles, sets (where there are too many kinds of characters to pack) and sketches agree with plain sets."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    for alphabet in ("abcdef é", "abc" + "".join(chr(0x4E00 + k) for k in range(700))):
        lines = []
        for _ in range(60):
            line = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 300)))
            cut = rng.randint(0, len(line) // 3)
            lines += [line, line[cut:] if len(line) - cut >= 7 else line + "x", line + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))]
        pairs = [(i, j) for i in range(0, len(lines), 3) for j in (i + 1, i + 2, (i + 3) % len(lines))]
        want = {(i, j) for i, j in pairs if len(grams(lines[i]) & grams(lines[j])) >= op.THRESHOLD * len(grams(lines[i]) | grams(lines[j]))}
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), pa.array([lines[i] for i, _ in pairs]), pa.array([lines[j] for _, j in pairs])], ["a", "b", "line_a", "line_b"])
        assert (op.exact_shingles(pa.array(lines)) is None) == (len(set("".join(lines))) > 512)
        got = {p for out in op.jaccard_pairs(iter([batch])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
        assert got == want and 0 < len(want) < len(pairs)
        (sketches,) = op.sketched(iter([pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], ["id", "line"])]))
        bits = np.array([np.frombuffer(s, np.uint64) for s in sketches.column("sketch").to_pylist()])
        n = np.asarray(sketches.column("n")).astype(np.int64)
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        left = {p for p, ok in zip(pairs, op.may_reach(n[a], bits[a], n[b], bits[b]), strict=True) if ok}
        assert want <= left and len(left) < len(pairs)


def test_edited_lines(spark):
    """Lines with one character or word changed inside, labelled by how they were made, and clean lines beside them."""
    rng = random.Random(12)
    rows, edited = [], set()

    def line(least, most):
        text = words(rng, 30)[: rng.randint(least, most)]
        return text.strip() + "."

    for d in range(0, 400, 2):
        if d % 4:
            a = line(30, 54)
            k = rng.randrange(8, len(a) - 8)
            b = a[:k] + "#" + a[k + 1 :]
        else:
            w = line(60, 100).split()
            a = " ".join(w)
            w[rng.randrange(1, len(w) - 1)] = "changed"
            b = " ".join(w)
        rows += [doc(d, a), doc(d + 1, b), doc(1000 + d, line(30, 100)), doc(1001 + d, line(100, 150))]
        edited.add((d + 1, d))
    got = {(r.doc_id, r.kept_doc_id) for r in op.duplicate_lines(frame(spark, rows)).collect()}
    assert got <= edited
    assert len(got) >= 0.95 * len(edited)


def test_rules_of_any_length(spark):
    """Lines of a few distinct shingles meet whatever their lengths."""
    rows = [doc(k, mark * n) for k, (mark, n) in enumerate([("-", 20), ("-", 59), ("-", 70), ("-", 5000), ("=-", 40), ("=-", 90)])]
    got = {(r.doc_id, r.kept_doc_id) for r in op.duplicate_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (5, 4)}


def test_near_lines_share_a_kind():
    """Any two lines that reach the threshold are banded as short both, or as long both."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(13)
    lines = []
    for _ in range(300):
        a = words(rng, rng.randint(2, 40))
        lines += [a, a + " " + words(rng, rng.randint(1, 10)), a * rng.randint(1, 4)]
    data, offsets = op.text_buffers(pa.array(lines))
    short, long = op.kinds_of(*op.shingles(op.padded(data, 0, int(offsets[-1])), offsets))
    sets = [grams(x) for x in lines]
    for i in range(0, len(lines), 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            if len(sets[a] & sets[b]) >= op.THRESHOLD * len(sets[a] | sets[b]):
                assert short[a] and short[b] or long[a] and long[b]
    assert op.LONG <= op.THRESHOLD * op.FEW and np.any(~short) and np.any(~long)


def test_blank_lines_of_any_white_space_stay(spark):
    texts = ["x one line\n\t\ny other line\n\t\nz third line", "four words are here\r\n\r\nfive words are not here\r\n\r\n\x0b\r", "six\n \t\r\n \t\r\nseven"]
    df = frame(spark, [doc(i, t) for i, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in op.dedup_lines(df).collect()} == dict(enumerate(texts))


def test_large_buckets_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = corpus(rng, 30)
    own = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in op.duplicate_lines(frame(spark, rows)).collect()}
    monkeypatch.setattr(op, "BUCKET_BLOCK", 2)
    assert {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in op.duplicate_lines(frame(spark, rows)).collect()} == own


def test_across_tries_all_pairs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 40
    ids, root, bucket, size = rng.permutation(n), rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(1, 300, n)
    bits = rng.random((n, op.SKETCH)) < 0.04
    bits[::2] = bits[0]
    packed = np.packbits(bits, axis=1, bitorder="little")
    words64 = packed.view(np.uint64)

    def table(i, j, which, block):
        return pa.table({"bucket": pa.array(bucket[which]), "i": pa.array(np.full(len(which), i)), "j": pa.array(np.full(len(which), j)), "block": pa.array(block), "id": ids[which], "root": root[which], "n": size[which], "sketch": pa.array([packed[k].tobytes() for k in which], pa.binary())})

    def want(pairs):
        ok = lambda x, y: root[x] != root[y] and op.may_reach(size[[x]], words64[[x]], size[[y]], words64[[y]])[0]
        return {(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in pairs if ok(x, y)}

    got = op.across(table(0, 0, np.arange(n), np.zeros(n, int)))
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want([(x, y) for x in range(n) for y in range(x) if bucket[x] == bucket[y]])
    bucket[:] = 5
    block = np.arange(n) % 2
    got = op.across(table(0, 1, np.arange(n), block))
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want([(x, y) for x in range(0, n, 2) for y in range(1, n, 2)])


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "one line of text here", "en", s, 21) for s in ("b", "a", "c")] * 2
    assert [tuple(r) for r in op.dedup_lines(frame(spark, rows)).collect()] == [(1, "one line of text here", "en", "a", 21)]


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "the very same line of text"), ("a", "the very same line of text")], "doc_id string, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in op.duplicate_lines(df).collect()] == [("b", "a")]


def test_both_kinds_of_shingles_share_their_characters():
    """Characters are read once; of one kind only the wanted lines, with the same shingles, signatures and bands."""
    lines = ["x", "", "eine längere Zeile über 日本語", "aaaaaaa", "", "short", "the last one, long enough for seven"]
    data, offsets = text_buffers(pa.array(lines))
    text, wanted = padded(data, 0, int(offsets[-1])), np.array([len(x) >= 7 for x in lines])
    c, ends = op.mixed_characters(text, offsets)
    assert np.diff(ends).tolist() == [len(x) for x in lines]
    h, rows = op.shingles_of(*op.of_rows(c, ends, wanted), 7)
    every, all_rows = op.of_rows(*op.shingles(text, offsets, 7), wanted)
    assert h.tolist() == every.tolist() and rows.tolist() == all_rows.tolist() and len(rows) == 4
    sig = op.signatures(h, rows)
    for i in range(3):
        own = h[rows[i] : rows[i + 1]].astype(np.uint64)
        assert sig[i].tolist() == [int(((own * m + a) & np.uint64(0xFFFFFFFF)).min()) for m, a in zip(op.MULTIPLY.astype(np.uint64), op.ADD.astype(np.uint64), strict=True)]
    keys = op.band_keys(sig)
    for b in range(op.BANDS):
        k = np.full(3, op.BAND_SEED[b])
        for r in range(op.ROWS):
            k = op.mix((k ^ sig[:, b * op.ROWS + r].astype(np.uint64)) * op.C1)
        assert keys[:, b].tolist() == k.tolist()
