"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the top down.

Every structural element is a node with features of its subtree (text, link share, density), its
attribute words, its depth and its place among its siblings. Trees give each node the odds that
it is part of the article. The decoding picks the likeliest labelling of the whole tree in which
a node kept has all its ancestors kept: a subtree is dropped whole, or its root stays and each
child is decided the same way. So no kept node stands in a dropped one, and a wrapper is not
dropped against the weight of what it holds.

The model is trained on ``TRAIN_PAGES`` generated pages, on the driver, the same every time.

Defined cases: null or empty html gives empty text, as do pages without text; repeated rows give
the same text; an empty table gives no rows; pages of any length are read whole; broken markup is
read as it stands; extra columns are kept, but for the html and for ones named as results (in any case).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotry.llm.htmltree import Node, clean, parse
from depotry.llm.pagegen import NAMES, Pages
from depotry.llm.trees import Forest, boost

TRAIN_PAGES, TREES, SEED = 2000, 80, 11
RESULTS = ("text", "n_chars")

# Groups of tags and of attribute words.
TAGS = (("nav", "menu"), ("header",), ("footer",), ("aside",), ("article", "main"), ("section",), ("div", "center"), ("p", "pre", "blockquote"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "dir"), ("li", "dt", "dd"), ("form", "button", "label", "fieldset", "legend"), ("table", "tr", "td", "th", "tbody", "thead"), ("figure", "figcaption"), ("dialog",))
GROUPS = tuple(k for k in NAMES if k != "neutral")
_TAG_GROUP = {tag: i for i, group in enumerate(TAGS) for tag in group}
_WORD_GROUP: dict[str, int] = {}
for _i, _k in enumerate(GROUPS):
    for _name in NAMES[_k]:
        for _w in _name.split("-"):
            if _w not in ("site", "main", "list", "more", "user", "slot", "body") or _k == "content":
                _WORD_GROUP.setdefault(_w, _i)
_WORD_GROUP |= {"comment": GROUPS.index("comments"), "reply": GROUPS.index("comments"), "contentinfo": GROUPS.index("footer"), "complementary": GROUPS.index("side"), "cookies": GROUPS.index("notice"), "privacy": GROUPS.index("notice"), "warning": GROUPS.index("notice"), "sponsors": GROUPS.index("ad"), "adverts": GROUPS.index("ad"), "menus": GROUPS.index("nav"), "links": GROUPS.index("nav")}
N_TAGS, N_GROUPS = len(TAGS), len(GROUPS)


def node_rows(root: Node) -> tuple[list[Node], list[list[float]], list[int]]:
    """All nodes in page order with their features and their parents' numbers."""
    order: list[Node] = []
    parents: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, up = stack.pop()
        number = len(order)
        order.append(node)
        parents.append(up)
        stack += [(c, number) for c in reversed(node.children)]
    n = len(order)
    own = [sum(len(p) for p in x.pieces if p.__class__ is str and not p.isspace()) for x in order]
    text, links, inputs, inner, paragraphs, stops = list(own), [x.links for x in order], [x.inputs for x in order], [1 + x.inline for x in order], [x.tag == "p" for x in order], [sum(p.count(". ") + p.count(", ") + p.rstrip().endswith((".", "!", "?")) for p in x.pieces if p.__class__ is str) for x in order]
    for i in range(n - 1, 0, -1):
        up = parents[i]
        for v in (text, links, inputs, inner, paragraphs, stops):
            v[up] += v[i]
    total, rows, depth, begin = max(1, text[0]), [], [0] * n, [0] * n
    above: list[list[float]] = []
    place: dict[int, tuple[int, int, float]] = {}
    at = 0
    for i, x in enumerate(order):
        up = parents[i]
        depth[i] = depth[up] + 1 if up >= 0 else 0
        begin[i] = at
        at += own[i]
        found = {_WORD_GROUP[w] for w in x.words if w in _WORD_GROUP}
        around = list(above[up]) if up >= 0 else [0.0] * N_GROUPS
        row = [0.0] * (N_TAGS + N_GROUPS)
        if (t := _TAG_GROUP.get(x.tag)) is not None:
            row[t] = 1.0
        for g in found:
            row[N_TAGS + g] = 1.0
        # What the elements around it are, by words and by tag.
        row += around
        for g in found:
            around[g] = 1.0
        if x.tag in ("nav", "header", "footer", "aside", "form"):
            around[{"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 6}[x.tag]] = 1.0
        above.append(around)
        kids = x.children
        tags = [k.tag for k in kids]
        often = Counter(tags)
        for j, k in enumerate(kids):
            place[id(k)] = (j, len(kids), often[k.tag] / len(kids))
        j, many, same = place.get(id(x), (0, 1, 1.0))
        t, d = text[i], max(1, inner[i])
        up_text = max(1, text[up]) if up >= 0 else total
        row += [
            log1p(t), links[i] / max(1, t), log1p(t / d), log1p(own[i]), own[i] / max(1, t), paragraphs[i], log1p(paragraphs[i]), stops[i] / max(1, t) * 100, inputs[i], len(kids),
            depth[i], begin[i] / total, (begin[i] + t) / total, t / total, t / up_text, j, j / many, many, same, log1p(t / max(1, len(kids))), float(len(x.words)),
        ]
        rows.append(row)
    return order, rows, parents


def decode(odds: np.ndarray, parents: list[int]) -> np.ndarray:
    """The likeliest labelling in which kept nodes have kept ancestors; the root is always kept."""
    keep = -np.logaddexp(0, -odds)  # log p
    drop = -np.logaddexp(0, odds)
    best, gone = keep.copy(), drop.copy()
    for i in range(len(parents) - 1, 0, -1):
        up = parents[i]
        best[up] += max(best[i], gone[i])
        gone[up] += gone[i]
    out = np.zeros(len(parents), bool)
    for i, up in enumerate(parents):
        out[i] = up < 0 or (out[up] and best[i] >= gone[i])
    return out


def blocks(root: Node, kept: dict[int, bool] | None = None) -> list[tuple[Node, str]]:
    """Text blocks in page order: runs of text between the edges of kept elements."""
    out: list[tuple[Node, str]] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    run: list[str] = []
    owner = root

    def close() -> None:
        if run:
            if text := clean(run):
                out.append((owner, text))
            run.clear()

    while stack:
        node, at = stack.pop()
        pieces = node.pieces
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.__class__ is str:
                owner = node
                run.append(piece)
            else:
                close()
                if kept is None or kept[id(piece)]:
                    stack.append((node, at))
                    node, at, pieces = piece, 0, piece.pieces
        close()
    return out


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Forest:
    """The model of generated pages; a node is main if its subtree holds a block of the article."""
    maker, rows, labels = Pages(seed), [], []
    for _ in range(pages):
        html, wanted = maker.page()
        root = parse(html)
        order, x, parents = node_rows(root)
        left = {}
        for w in wanted:
            w = " ".join(w.split())
            left[w] = left.get(w, 0) + 1
        main = {id(node) for node, text in blocks(root) if left.get(text)}
        y = [id(n) in main for n in order]
        for i in range(len(order) - 1, 0, -1):
            y[parents[i]] |= y[i]
        rows += x[1:]
        labels += y[1:]
    return boost(np.array(rows, float), np.array(labels, float), TREES)


def main_texts(pages: list[str | None], model: Forest) -> list[str]:
    """Main text of each page: its blocks joined by two line ends."""
    roots = [parse(p or "") for p in pages]
    read = [node_rows(r) for r in roots]
    odds = model.log_odds(np.array([row for _, rows, _ in read for row in rows], float)) if read else np.zeros(0)
    out, at = [], 0
    for root, (order, rows, parents) in zip(roots, read, strict=True):
        kept = decode(odds[at : at + len(rows)], parents)
        at += len(rows)
        out.append("\n\n".join(t for _, t in blocks(root, {id(n): bool(k) for n, k in zip(order, kept, strict=True)})))
    return out


def extract(pages: DataFrame, html: str = "html", model: Forest | None = None) -> DataFrame:
    """The columns of ``pages`` but for the html, with ``text`` and ``n_chars`` (code points)."""
    model = model or trained()
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), *RESULTS)]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for at in range(0, b.num_rows, 100):
                texts += main_texts(b.column(0).slice(at, 100).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[1:], *RESULTS])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string, n_chars long"])
    return pages.select(F.col(f"`{html}`").cast("string").alias("__html"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
