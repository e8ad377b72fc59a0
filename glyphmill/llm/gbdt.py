"""Histogram gradient-boosted trees for a binary label, in numpy; trees are flat arrays of one complete binary layout."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """feature, threshold: a row for each tree, with node i's children at 2i + 1 and 2i + 2; value: the leaves' scores."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows go down a tree level by level at once."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Forest:
    """Boosts logistic loss. Without rows, or with one class, the forest is a constant (0.5, or the class softened)."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        trees = 0
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)] if trees else []
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1) if trees else None
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            pick, cut = np.zeros(count, np.int64), np.full(count, -1)
            for f in range(width):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                at = local * k + binned[:, f]
                g, h, c = (np.bincount(at, w, count * k).reshape(count, k) for w in (grad, hess, None))
                gl, hl, cl = (np.cumsum(v, 1)[:, :-1] for v in (g, h, c))
                gt, ht, ct = g.sum(1)[:, None], h.sum(1)[:, None], c.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                j = gain.argmax(1)
                top = gain[np.arange(count), j]
                better = top > best + 1e-9
                best[better], pick[better], cut[better] = top[better], f, j[better]
            for i in range(count):
                if cut[i] >= 0:
                    features[t, first + i], thresholds[t, first + i] = pick[i], cuts[pick[i]][cut[i]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        margin += values[t][leaf]
    return Forest(base, depth, features, thresholds, values)
