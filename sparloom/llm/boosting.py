"""Gradient-boosted trees in numpy: logistic loss, depth-two trees over quantile cuts. Small, deterministic, trained here."""

from __future__ import annotations

import numpy as np


class Boosted:
    """A binary classifier for a handful of features; fitted on a bounded sample."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, cuts: int = 16):
        self.rounds, self.rate, self.cuts, self.trees, self.base = rounds, rate, cuts, [], 0.0

    def _split(self, x, g, h, rows):
        """The cut of one node with the largest gain: (feature, threshold, gain)."""
        best, total_g, total_h = (0, np.inf, 0.0), g[rows].sum(), h[rows].sum() + 1.0
        for f in range(x.shape[1]):
            v = x[rows, f]
            for t in self.grid[f]:
                left = v <= t
                gl, hl = g[rows][left].sum(), h[rows][left].sum() + 1.0
                gr, hr = total_g - gl, total_h - hl + 1.0
                gain = gl * gl / hl + gr * gr / hr - total_g * total_g / total_h
                if gain > best[2] + 1e-12:
                    best = (f, float(t), float(gain))
        return best

    @staticmethod
    def _leaf(g, h, rows):
        return float(g[rows].sum() / (h[rows].sum() + 1.0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 1)[:-1])) for f in range(x.shape[1])]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            every = np.arange(len(y))
            f, t, gain = self._split(x, g, h, every)
            if gain <= 1e-9:
                break
            sides = []
            for side in (every[x[:, f] <= t], every[x[:, f] > t]):
                f2, t2, gain2 = self._split(x, g, h, side) if len(side) > 1 else (0, np.inf, 0.0)
                if gain2 <= 1e-9:
                    f2, t2 = 0, np.inf
                low, high = side[x[side, f2] <= t2], side[x[side, f2] > t2]
                sides.append((f2, t2, self.rate * self._leaf(g, h, low) if len(low) else 0.0, self.rate * self._leaf(g, h, high) if len(high) else 0.0))
            self.trees.append((f, t, sides))
            score += self._tree(x, self.trees[-1])
        return self

    @staticmethod
    def _tree(x, tree):
        f, t, ((fa, ta, a0, a1), (fb, tb, b0, b1)) = tree
        return np.where(x[:, f] <= t, np.where(x[:, fa] <= ta, a0, a1), np.where(x[:, fb] <= tb, b0, b1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._tree(x, tree)
        return 1 / (1 + np.exp(-score))
