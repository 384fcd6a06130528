"""HTML extraction: flat text blocks classified by a decision tree on shallow features.

A page is cut at block-level tags into flat blocks of text. Features of a block are word count and link density (words
inside anchors by all words) of itself, its predecessor and its successor. A decision tree (CART, Gini) trained on a small
labelled table of blocks says which are content; these joined by newlines are the page's text.

Defined cases: a null page has null text; a page without content blocks has an empty one; markup that never closes ends
with the page; a very long page is read whole; repeated pages each give their row; an empty table gives no rows; page_id
has any type; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean

#: The labelled table: words and link density of predecessor, block and successor; 1 is content.
LABELLED = np.array(
    [
        # navigation, menus and lists of links
        (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 2, 1, 1, 1, 0), (2, 1, 1, 1, 5, 0, 0), (0, 0, 6, 1, 4, 0.5, 0), (0, 0, 3, 1, 12, 0, 0),
        (12, 0.9, 25, 0.8, 10, 1, 0), (80, 0, 8, 1, 8, 1, 0), (8, 1, 8, 1, 8, 1, 0), (8, 1, 30, 0.6, 3, 0, 0), (1, 1, 4, 0, 10, 0, 0), (1, 1, 14, 0, 9, 0, 0),
        (2, 1, 7, 0, 60, 0, 0), (1, 1, 9, 0, 12, 0, 0), (1, 1, 11, 0, 5, 0, 0), (2, 1, 18, 0, 11, 0, 0), (1, 1, 3, 0, 8, 0, 0), (1, 1, 20, 0, 8, 0, 0),
        # advertisements and notices before the text, footers after it
        (0, 0, 4, 0, 6, 0, 0), (0, 0, 12, 0, 8, 0, 0), (1, 1, 6, 0.3, 70, 0, 0), (90, 0, 8, 0, 0, 0, 0), (60, 0, 14, 0, 0, 0, 0), (40, 0, 5, 0.2, 0, 0, 0),
        (120, 0, 20, 0, 0, 0, 0), (15, 0, 6, 0, 0, 0, 0), (30, 0, 17, 0.1, 0, 0, 0), (7, 0, 3, 0, 0, 0, 0), (200, 0, 11, 0.5, 0, 0, 0), (55, 0, 3, 0, 3, 1, 0),
        (10, 0.5, 4, 0, 1, 1, 0), (3, 0, 2, 0, 2, 0, 0), (5, 0.6, 9, 0.4, 4, 1, 0), (0, 0, 2, 0, 0, 0, 0), (20, 0.4, 12, 0.6, 20, 0.5, 0), (25, 0, 10, 0, 0, 0, 0),
        # headlines before text, paragraphs, short paragraphs between long ones
        (4, 0, 8, 0, 80, 0, 1), (12, 0, 10, 0, 60, 0, 1), (8, 0, 11, 0, 120, 0, 1), (10, 0, 9, 0, 30, 0, 1), (6, 0, 7, 0, 45, 0, 1), (14, 0, 12, 0, 200, 0, 1),
        (8, 0, 80, 0, 60, 0, 1), (60, 0, 90, 0.02, 120, 0, 1), (120, 0, 45, 0, 8, 0, 1), (10, 0, 200, 0.05, 9, 0, 1), (9, 0, 30, 0, 50, 0, 1), (50, 0, 25, 0, 70, 0, 1),
        (70, 0, 12, 0, 80, 0, 1), (40, 0, 6, 0, 90, 0, 1), (35, 0, 3, 0, 60, 0, 1), (90, 0, 17, 0, 44, 0, 1), (66, 0, 30, 0.1, 0, 0, 1), (0, 0, 150, 0.03, 0, 0, 1),
        (1, 1, 60, 0, 70, 0, 1), (1, 1, 120, 0.1, 12, 0, 1), (25, 0, 40, 0.2, 30, 0, 1), (80, 0, 55, 0.25, 8, 0, 1), (45, 0, 9, 0, 33, 0, 1), (30, 0, 36, 0, 6, 0, 1),
        (100, 0, 24, 0, 12, 0, 1), (60, 0, 9, 0, 12, 0, 1), (45, 0, 4, 0, 10, 0, 1), (33, 0, 12, 0, 15, 0, 1), (28, 0, 28, 0, 11, 0, 1), (70, 0, 5, 0, 9, 0, 1),
    ]
)


@dataclass(frozen=True)
class Node:
    feature: int
    cut: float
    low: Node | bool
    high: Node | bool


def train_tree(table: np.ndarray = LABELLED, depth: int = 6, least: int = 2) -> Node | bool:
    """CART by Gini impurity; ties by feature order, then the least cut."""
    x, y = table[:, :-1], table[:, -1]
    p = y.mean() if len(y) else 0
    if depth == 0 or p in (0, 1):
        return bool(p >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None or best[0] >= len(y) * p * (1 - p) - 1e-12:
        return bool(p >= 0.5)
    low = x[:, best[1]] < best[2]
    return Node(best[1], best[2], train_tree(table[low], depth - 1, least), train_tree(table[~low], depth - 1, least))


def classify(node: Node | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(node, bool):
        return np.full(len(x), node)
    low = x[:, node.feature] < node.cut
    out = np.empty(len(x), bool)
    out[low] = classify(node.low, x[low])
    out[~low] = classify(node.high, x[~low])
    return out


HIDDEN = "script|style|noscript|template|head|svg|iframe|textarea|select"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr br big img".split())


def text_blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each flat block."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, depth, at = 0, 0, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if depth:
                linked += len(raw.split())

    def close() -> None:
        nonlocal linked
        words = html.unescape("".join(parts)).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            if m.group(1):
                close()
            continue
        name = name.lower()
        if name == "a":
            depth = max(0, depth - 1) if m.group(2) else 1
        elif name not in INLINE:
            close()
        elif name == "br":
            add(" ")
    add(page[at:])
    close()
    return out


def extract_page(page: str, tree: Node | bool) -> tuple[str, int, int]:
    """(text, blocks, blocks of content)."""
    blocks = text_blocks(page)
    if not blocks:
        return "", 0, 0
    own = np.array([(w, k / w) for _, w, k in blocks])
    edge = np.zeros((1, 2))
    content = classify(tree, np.hstack([np.vstack([edge, own[:-1]]), own, np.vstack([own[1:], edge])]))
    return "\n".join(b[0] for b, c in zip(blocks, content, strict=True) if c), len(blocks), int(content.sum())


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """(page_id, text, n_blocks, n_content). One scan, no shuffle; the tree is fit on the driver on the labelled table."""
    tree = train_tree(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, 0, 0) if p is None else extract_page(p, tree) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    bounded(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(lean(run), f"page_id {dict(pages.dtypes)['page_id']}, text string, n_blocks int, n_content int")
