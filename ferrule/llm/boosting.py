"""Gradient-boosted trees for two classes, by histograms; small enough to send to every task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST = 80, 4, 0.3, 32, 8


@dataclass
class Boosted:
    """Complete trees: a feature and a threshold for each inner node, a value for each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Chances of class 1 of the rows of ``x``."""
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic loss; each level of a tree takes the best split of each of its nodes over binned features."""
    n, m = x.shape
    mean = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    model = Boosted(float(np.log(mean / (1 - mean))), np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH)))
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z = np.full(n, model.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h, at = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = (at - first)[:, None] * (m * BINS) + np.arange(m) * BINS + binned
            shape = (width, m, BINS)
            sums = [np.bincount(key.ravel(), np.repeat(v, m), width * m * BINS).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            left, all_ = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
            gain = left[0] ** 2 / (left[1] + 1) + (all_[0] - left[0]) ** 2 / (all_[1] - left[1] + 1) - all_[0] ** 2 / (all_[1] + 1)
            gain[(left[2] < LEAST) | (all_[2] - left[2] < LEAST)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                f, b = divmod(int(best[node]), BINS - 1)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    model.feature[t, first + node], model.threshold[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), model.feature[t][at]] > model.threshold[t][at])
        at -= 2**DEPTH - 1
        model.leaf[t] = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        z += model.leaf[t][at]
    return model
