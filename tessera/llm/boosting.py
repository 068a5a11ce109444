"""Gradient-boosted trees for a binary label: logistic loss, histogram splits, second-order leaves."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth, stored level by level as arrays, so that scoring is a few gathers a level."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                gain = np.zeros(n)
                at = np.full((n, 2), -1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    key = (node - first) * size + code[:, f]
                    gs = np.bincount(key, g, n * size).reshape(n, size).cumsum(1)
                    hs = np.bincount(key, h, n * size).reshape(n, size).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    q = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    q[(hl < self.least) | (ht - hl < self.least)] = 0
                    best = q.argmax(1)
                    better = q[np.arange(n), best] > gain + 1e-12
                    gain[better] = q[np.arange(n), best][better]
                    at[better, 0], at[better, 1] = f, best[better]
                for k in np.flatnonzero(at[:, 0] >= 0):
                    feature[first + k] = at[k, 0]
                    cut[first + k] = edges[at[k, 0]][at[k, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest score from which the share of true labels is at least precision; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)  # ties stand or fall together
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 1.1
