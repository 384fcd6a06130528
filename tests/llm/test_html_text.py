import random
from html.parser import HTMLParser

import numpy as np

from lumenseek.llm import html_text as op

from .fixtures import words


def test_blocks():
    page = "<html><head><title>t</title></head><body><ul><li><a href=x>one two</a></li></ul><p>a <b>bold</b>&amp; <a>link</a> end<br>next</p><script>var a='<p>no</p>'</script><!-- <p>no</p> -->last"
    assert op.text_blocks(page) == [("one two", 2, 2), ("a bold& link end next", 5, 1), ("last", 1, 0)]


def test_tree_separates_the_table():
    tree = op.train_tree()
    assert (op.classify(tree, op.LABELLED[:, :-1]) == op.LABELLED[:, -1]).mean() > 0.9
    held = np.array([(1, 1, 1, 1, 1, 1, 0), (3, 0, 90, 0, 80, 0, 1), (60, 0, 70, 0.02, 50, 0, 1), (2, 1, 3, 1, 2, 1, 0), (50, 0, 9, 0.6, 0, 0, 0)])
    assert (op.classify(tree, held[:, :-1]) == held[:, -1]).all()


def test_best_split_by_trying_all():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (60, 3)).astype(float)
    table = np.column_stack([x, x[:, 1] > 4])
    tree = op.train_tree(table)
    assert tree == op.Node(1, 4.5, False, True)


def test_article_text(spark):
    long = " ".join(["word"] * 60)
    page = f"<nav><a>home</a><a>about us</a></nav><h1>A title of some words</h1><p>{long}</p><p>{long} <a>x</a></p><div><a>more</a> <a>news</a></div><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (None, None, "<p>unclosed <b"), (5, "u", "<p>" + "long " * 100_000), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_blocks")
    got = op.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text.count("word") == 120 and "home" not in by[1].text and "news" not in by[1].text and "us" not in by[1].text.split()
    assert by[2].text is None and by[3].text == ""
    assert len(by[5].text.split()) == 100_000
    assert op.extract(df.limit(0)).count() == 0


def test_never_closing_markup():
    tree = op.train_tree()
    for page in ("<", "<script>", "<!--", "<a <b <c", "</p", "<style>x", "<" * 10_000, "<script" * 3000):
        op.extract_page(page, tree)


class Twin(HTMLParser):
    """Blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.linked, self.depth, self.hidden = [], [], 0, 0, []

    def close_block(self):
        words = "".join(self.parts).split()
        if words:
            self.blocks.append((" ".join(words), len(words), min(self.linked, len(words))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in op.HIDDEN.split("|"):
            self.close_block()
            self.hidden.append(tag)
        elif tag == "a":
            self.depth = 1
        elif tag not in op.INLINE:
            self.close_block()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag == "a":
            self.depth = 0
        elif tag not in op.INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.depth:
                self.linked += len(data.split())


def gini_tree(table, depth=6, least=2):
    """CART by trying every split of every feature."""
    y = [r[-1] for r in table]
    p = sum(y) / len(y) if y else 0
    impurity = lambda rows: len(rows) * (q := sum(r[-1] for r in rows) / len(rows)) * (1 - q)
    if depth == 0 or p in (0, 1):
        return p >= 0.5
    best = None
    for f in range(len(table[0]) - 1):
        values = sorted({r[f] for r in table})
        for cut in [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]:
            low, high = [r for r in table if r[f] < cut], [r for r in table if r[f] >= cut]
            if min(len(low), len(high)) >= least and (best is None or impurity(low) + impurity(high) < best[0] - 1e-12):
                best = (impurity(low) + impurity(high), f, cut, low, high)
    if best is None or best[0] >= len(y) * p * (1 - p) - 1e-12:
        return p >= 0.5
    return (best[1], best[2], gini_tree(best[3], depth - 1, least), gini_tree(best[4], depth - 1, least))


def test_against_a_parser_and_an_exhaustive_tree(spark):
    rng = random.Random(3)
    tree = gini_tree([tuple(r) for r in op.LABELLED.tolist()])

    def says(x):
        node = tree
        while not isinstance(node, bool):
            node = node[2] if x[node[0]] < node[1] else node[3]
        return node

    def block():
        text = words(rng, rng.choice([1, 3, 8, 20, 60]))
        if rng.random() < 0.4:
            text = f"<a href='x'>{text}</a> {words(rng, rng.choice([0, 1, 5]))}"
        tag = rng.choice(["p", "div", "li", "h2", "td"])
        return f"<{tag} class=\"k\">{text} &amp; <b>bold</b><br>after</{tag}>" + rng.choice(["", "<script>var x = 1</script>", "<!-- note -->", "loose words"])

    pages = [(i, "".join(block() for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = {r.page_id: r for r in op.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    for i, page in pages:
        twin = Twin()
        twin.feed(page)
        twin.close()
        twin.close_block()
        b = [(0, 0), *((n, k / n) for _, n, k in twin.blocks), (0, 0)]
        kept = [t[0] for k, t in enumerate(twin.blocks) if says([*b[k], *b[k + 1], *b[k + 2]])]
        assert (got[i].text, got[i].n_blocks, got[i].n_content) == ("\n".join(kept), len(twin.blocks), len(kept))
