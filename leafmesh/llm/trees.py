"""Gradient-boosted trees for two classes in numpy, on features sorted into bins; and the calibration of their scores."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Trees of fixed depth, fitted to the logistic loss; `margin` adds their leaves up."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 1.0, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.penalty, self.least = trees, depth, rate, penalty, least
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves: list[np.ndarray] = []
        self.slope, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """Fits to rows x with labels y in 0 and 1; a single class, or no row, gives a constant."""
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
        n, features = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(features)]
        share = min(0.999, max(0.001, float((w * y).sum() / max(w.sum(), 1e-9)) if n else 0.001))
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        b = self._binned(x)
        flat = b + np.arange(features) * BINS
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
            node = np.zeros(n, dtype=np.int64)
            which, where = np.zeros((1 << self.depth) - 1, dtype=np.int64), np.full((1 << self.depth) - 1, BINS, dtype=np.int64)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                at = ((node[:, None] - first) * (features * BINS) + flat).ravel()
                gs = np.bincount(at, weights=np.repeat(g, features), minlength=wide * features * BINS).reshape(wide, features, BINS).cumsum(axis=2)
                hs = np.bincount(at, weights=np.repeat(h, features), minlength=wide * features * BINS).reshape(wide, features, BINS).cumsum(axis=2)
                G, H = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.penalty) + (G - gs) ** 2 / (H - hs + self.penalty) - G**2 / (H + self.penalty)
                gain[(hs < self.least * 0.1) | (H - hs < self.least * 0.1)] = -1
                best = gain.reshape(wide, -1).argmax(axis=1)
                good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
                which[first : first + wide] = best // BINS
                where[first : first + wide] = np.where(good, best % BINS, BINS)
                node = 2 * node + 1 + (b[np.arange(n), which[node]] > where[node])
            leaf = node - ((1 << self.depth) - 1)
            value = -self.rate * np.bincount(leaf, weights=g, minlength=1 << self.depth) / (np.bincount(leaf, weights=h, minlength=1 << self.depth) + self.penalty)
            margin += value[leaf]
            self.splits.append((which, where))
            self.leaves.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row before calibration."""
        x = np.asarray(x, dtype=float)
        out = np.full(len(x), self.base)
        if not len(x) or not self.splits:
            return out
        b = self._binned(x)
        rows = np.arange(len(x))
        for (which, where), value in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, which[node]] > where[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Fits slope and shift of the log-odds to held-out labels, with targets drawn in from 0 and 1."""
        m, y = self.margin(x), np.asarray(y, dtype=float)
        if not len(y) or y.min() == y.max():
            return self
        good, bad = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        def loss(a: float, c: float) -> float:
            f = a * m + c
            return float((np.logaddexp(0, f) - target * f).sum() + 0.01 * (a - 1) ** 2)

        a, c = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            d, h = p - target, np.maximum(p * (1 - p), 1e-9)
            ga, gc = (d * m).sum() + 0.02 * (a - 1), d.sum()
            haa, hac, hcc = (h * m * m).sum() + 0.02, (h * m).sum(), h.sum() + 1e-6
            det = haa * hcc - hac * hac
            da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
            t, now = 1.0, loss(a, c)
            while t > 1e-6 and loss(a - t * da, c - t * dc) > now:
                t /= 2
            a, c = a - t * da, c - t * dc
            if t * (abs(da) + abs(dc)) < 1e-7:
                break
        self.slope, self.shift = float(max(a, 0.05)), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


__all__ = ["Boosted"]
