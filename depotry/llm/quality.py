"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another; each visit fits a tree of a few leaves to the
gradients by bin and adds it to the feature's lookup table. Then the strongest pairs of features
get tables of their own, boosted the same way. A score is the logistic of the intercept and one
looked-up number for each feature and pair.

The fit takes at most ``MOST_LABELLED`` labelled rows, those of the smallest id hashes, so its
time and memory are bounded; features of a text are counts of the whole text. Scoring covers
every row. Ids, labels, languages and sources are not features.

Defined cases: null text is empty text and is scored; labels that are null are ignored; with one
label alone every score is that label's; repeated rows score alike; an empty table gives no rows;
extra columns are kept, but for the text and for ones named as results (in any case).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotry.llm.docstats import COUNTS, text_counts
from depotry.llm.shared import forget, small_batches

MOST_LABELLED = 20_000
BINS, COARSE, PAIRS = 64, 16, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.1, 3
#: Ridge on a leaf and the least rows in it.
RIDGE, LEAST = 1.0, 8
RESULTS = ("score", "predicted")

FEATURES = ("size", "word_length", "symbols", "dup_lines", "repeats", "variety", "top_word", "capitals", "digits", "marks", "bars", "wide", "short_lines", "closed_lines", "shouts", "line_words")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    c = dict(zip(COUNTS, text_counts(texts).astype(float).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = (
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        np.log(np.maximum(c["n_distinct"], 1)) - 0.85 * np.log(words), c["top_word"] / words * np.minimum(1, words / 20), c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_marks"] / chars, c["n_bars"] / words, c["n_wide"] / chars, c["n_short_lines"] / lines, c["n_closed"] / lines, c["n_shouts"] / words, np.log1p(words / lines),
    )
    return np.stack(columns, axis=1)


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], axis=1)

    def coarse(self, bins: np.ndarray, i: int) -> np.ndarray:
        return bins[:, i] * COARSE // (len(self.cuts[i]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            total += t[bins[:, i]]
        for i, j, t in self.pairs:
            total += t[self.coarse(bins, i), self.coarse(bins, j)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step for each bin: a tree of up to LEAVES leaves over sums by bin."""
    edges = [0, len(g)]
    G, H, N = (np.concatenate(([0], np.cumsum(v))) for v in (g, h, n))
    while len(edges) <= LEAVES:
        best = (1e-9, 0)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = np.arange(a + 1, b)
            k = k[(N[k] - N[a] >= LEAST) & (N[b] - N[k] >= LEAST)]
            if len(k):
                gains = _gain(G[k] - G[a], H[k] - H[a]) + _gain(G[b] - G[k], H[b] - H[k]) - _gain(G[b] - G[a], H[b] - H[a])
                if gains.max() > best[0]:
                    best = (float(gains.max()), int(k[gains.argmax()]))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    return np.concatenate([np.full(b - a, (G[b] - G[a]) / (H[b] - H[a] + RIDGE)) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, a step for each cell) of the best cut of a table into four."""
    def cum(v: np.ndarray) -> np.ndarray:
        return np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[1:-1, 1:-1] if v.size else v

    a, c = cum(g), cum(h)
    rows_g, rows_h = g.sum(1).cumsum()[:-1, None], h.sum(1).cumsum()[:-1, None]
    cols_g, cols_h = g.sum(0).cumsum()[None, :-1], h.sum(0).cumsum()[None, :-1]
    G = (a, rows_g - a, cols_g - a, g.sum() - rows_g - cols_g + a)
    H = (c, rows_h - c, cols_h - c, h.sum() - rows_h - cols_h + c)
    gain = sum(_gain(x, y) for x, y in zip(G, H, strict=True)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.empty_like(g)
    for (x, y), rows, cols in zip(zip(G, H, strict=True), (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        step[rows, cols] = x[i, j] / (y[i, j] + RIDGE)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of labels ``y`` (0 or 1) given feature rows ``x``."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9))
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    model = Additive(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    if len(np.unique(y)) < 2:
        return model
    bins, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    counts = [np.bincount(bins[:, i], minlength=len(t)) for i, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _leaves(*(np.bincount(bins[:, i], v, len(table)) for v in (g, h)), counts[i])
            table += step
            total += step[bins[:, i]]
    coarse = [model.coarse(bins, i) for i in range(x.shape[1])]

    def crossed(i: int, j: int) -> tuple[float, np.ndarray]:
        cell = coarse[i] * COARSE + coarse[j]
        g, h = slopes()
        return _quarters(*(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h)))

    ranked = sorted(((crossed(i, j)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * crossed(i, j)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Additive:
    """Fit to ``labels(doc_id, quality)`` of the documents, at most ``most`` of them."""
    small_batches(docs.sparkSession)
    some = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # At most ``most`` ids are broadcast, and as many feature rows come back.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Additive, threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (its text only if asked for) with ``score`` and ``predicted``."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in RESULTS and (keep_text or c.lower() != "text")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            p = model.score(features(b.column(0))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*b.schema.names[1:], *RESULTS])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "score double, predicted int"])
    return docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
