"""Gradient-boosted regression trees for binary labels, with Platt calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting over quantile bins. Trees are complete binary trees stored level by level."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        y = y.astype(np.float64)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, split = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins + 1)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                local = node - base
                best = np.full(width, 1e-9)
                for f in range(b.shape[1]):
                    cell = local * (self.bins + 1) + b[:, f]
                    gs = np.bincount(cell, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(cell, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.least) + (gt - gs) ** 2 / (ht - hs + self.least) - gt**2 / (ht + self.least)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[base : base + width][better] = f
                    split[base : base + width][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > split[node])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.least)
            self.model.append((feature, split, value * self.rate))
            margin += self.rate * value[leaf]
        self.platt = (1.0, 0.0)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, split, value in self.model:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> "Boosted":
        """Platt scaling on held-out rows; labels are smoothed so that separable rows stay finite."""
        m = self.margin(x)
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * m).sum(), (p - t).sum()])
            hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-3 * np.eye(2)
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
        self.platt = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))
