"""Gradient-boosted trees with a logistic loss, and isotonic calibration, in NumPy.

Models are fitted on a bounded sample on the driver and sent to executors with the scoring function.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, penalty: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows of features, all finite; y: 0 or 1. Without rows, or with one class only, it scores the smoothed share."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.forest = float(np.log(share / (1 - share))), []
        if len(np.unique(y)) < 2:
            return self
        b, f = self._binned(x), np.full(len(x), self.base)
        width, cells = x.shape[1], self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(x), np.int64), []
            for level in range(self.depth):
                n = 1 << level
                at = (node[:, None] * width + np.arange(width)) * cells + b
                sums = [np.bincount(at.ravel(), np.repeat(v, width), n * width * cells).reshape(n, width, cells).cumsum(2) for v in (grad, hess, np.ones(len(x)))]
                g, h, c = sums
                gt, ht, ct = g[..., -1:], h[..., -1:], c[..., -1:]
                gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                gain = np.where((c >= self.least) & (ct - c >= self.least), gain, -1.0).reshape(n, -1)
                best = gain.argmax(1)
                feature, cut = best // cells, best % cells
                cut = np.where(gain.max(1) > 1e-9, cut, cells)  # no split: all go left
                splits.append((feature, cut))
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            g, h = (np.bincount(node, v, 1 << self.depth) for v in (grad, hess))
            leaf = -self.rate * g / (h + self.penalty)
            self.forest.append((splits, leaf))
            f += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        out = np.full(len(x), self.base)
        if not self.forest or not len(x):
            return out
        b, rows = self._binned(x), np.arange(len(x))
        for splits, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


class Isotonic:
    """Non-decreasing map from margins to probabilities: pool adjacent violators, linear between the pools."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, count, sum of x
        for a, b in zip(x[order], y[order], strict=True):
            pools.append([float(b), 1.0, float(a)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
        # One half observation of each class keeps scores off 0 and 1.
        self.x = np.array([p[2] / p[1] for p in pools]) if pools else np.zeros(1)
        self.y = np.array([(p[0] + 0.5 * p[1] / (p[1] + 1)) / (p[1] + p[1] / (p[1] + 1)) for p in pools]) if pools else np.full(1, 0.5)
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    rank = np.empty(len(s))
    _, first, n = np.unique(s, return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (n + 1) / 2, n)
    pos = y == 1
    k = pos.sum()
    return float((rank[pos].sum() - k * (k + 1) / 2) / max(1, k * (len(y) - k)))
