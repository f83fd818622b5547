"""Gradient-boosted trees for a yes/no label, by histograms of binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting: each tree is fitted to gradients, split where the gain is greatest (ties: first feature, lowest bin).

    Fitting is deterministic: no rows or features are sampled. A model with no rows, or one label only, gives that label's rate.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, min_rows: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.min_rows = trees, depth, rate, bins, l2, min_rows
        self.base, self.edges, self.forest = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        if len(y) == 0 or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            f += self._walk(tree, b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        f = np.full(len(x), self.base)
        if len(x) and self.forest:
            b = self._binned(np.asarray(x, float))
            for tree in self.forest:
                f += self._walk(tree, b)
        return 1 / (1 + np.exp(-f))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * total_g / (total_h + self.l2)
        if depth == 0 or len(rows) < 2 * self.min_rows:
            return leaf
        best = (1e-9, None, None)
        for k in range(b.shape[1]):
            n = len(self.edges[k]) + 1
            left_g = np.cumsum(np.bincount(b[rows, k], g[rows], n))[:-1]
            left_h = np.cumsum(np.bincount(b[rows, k], h[rows], n))[:-1]
            left_n = np.cumsum(np.bincount(b[rows, k], minlength=n))[:-1]
            gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(left_n < self.min_rows) | (len(rows) - left_n < self.min_rows)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        _, k, cut = best
        if k is None:
            return leaf
        go = b[rows, k] <= cut
        return k, cut, self._grow(b, g, h, rows[go], depth - 1), self._grow(b, g, h, rows[~go], depth - 1)

    def _walk(self, tree, b) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        k, cut, left, right = tree
        return np.where(b[:, k] <= cut, self._walk(left, b), self._walk(right, b))
