"""Gradient-boosted trees for two classes in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete trees of one depth: a feature and a cut for each inner node, a step for each leaf."""

    depth: int
    start: float
    features: np.ndarray
    cuts: np.ndarray
    steps: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, s in zip(self.features, self.cuts, self.steps, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += s[at - (1 << self.depth) + 1]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: float = 4.0, share_of_rows: float = 0.4, seed: int = 1) -> Forest:
    """Newton boosting of the logistic loss over histograms of ``BINS`` bins; each tree sees a random share of the rows."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    total, inner = np.full(len(y), start), (1 << depth) - 1
    all_f, all_c, all_s = [], [], []
    rng, drawn = np.random.default_rng(seed), max(1, int(share_of_rows * len(y)))
    by_feature = np.ascontiguousarray(bins.T)
    for _ in range(trees):
        own = np.sort(rng.permutation(len(y))[:drawn])
        p = 1 / (1 + np.exp(-total[own]))
        g, h = y[own] - p, np.maximum(p * (1 - p), 1e-9)
        at, f, c, some, xs = np.zeros(drawn, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf), by_feature[:, own], x[own]
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width) + 1e-9
            for i, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * BINS + some[i]
                G, H = (np.bincount(cell, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                left_g, left_h, sum_g, sum_h = G[:, :-1], H[:, :-1], G[:, -1:], H[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(left_h < least * 0.01) | (sum_h - left_h < least * 0.01)] = 0
                gain[:, len(e) :] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                f[first : first + width][better] = i
                c[first : first + width][better] = e[top[better]]
            at = 2 * at + 1 + (xs[np.arange(drawn), f[at]] > c[at])
        leaf = at - inner
        step = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        total += Forest(depth, 0.0, f[None], c[None], step[None]).log_odds(x)
        all_f.append(f)
        all_c.append(c)
        all_s.append(step)
    return Forest(depth, start, np.array(all_f), np.array(all_c), np.array(all_s))
