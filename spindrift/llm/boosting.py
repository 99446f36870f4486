"""Histogram gradient-boosted trees with logistic loss, and isotonic calibration, in numpy.

Training sees a bounded matrix only; a fitted model is a few kilobytes of arrays that travel with a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Complete binary trees: feature and threshold of the inner nodes, values of the leaves; a tree a row."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, min_weight: float = 2.0) -> Boosted:
    """Level-wise trees on quantile bins. One class alone, or no rows, gives a constant model."""
    n, m = x.shape
    y = y.astype(float)
    p = (y.sum() + 0.5) / (n + 1) if n else 0.0
    base = float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
    none = Boosted(base, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), depth)
    if n < 2 or y.min() == y.max():
        return none
    edges = [_edges(np.unique(x[:, j]), x[:, j], bins) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    raw, trees = np.full(n, base), []
    for _ in range(rounds):
        prob = sigmoid(raw)
        g, h = y - prob, prob * (1 - prob)
        feature, threshold, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.full(2**depth - 1, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            size = count * m * bins
            gs = np.bincount(at, np.repeat(g, m), size).reshape(count, m, bins)
            hs = np.bincount(at, np.repeat(h, m), size).reshape(count, m, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < min_weight) | (ht - hl < min_weight)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k], cut[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        raw += value[leaf]
        trees.append((feature, threshold, value))
    f, t, v = (np.stack(z) for z in zip(*trees))
    return Boosted(base, f, t, v, depth)


def _edges(values: np.ndarray, column: np.ndarray, bins: int) -> np.ndarray:
    """At most bins-1 upper edges of bins, between values that occur."""
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[:-1] + values[1:]) / 2


@dataclass
class Isotonic:
    """Monotone step-wise linear map from raw scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators; with fewer than two classes the sigmoid stays."""
    if len(y) < 2 or y.min() == y.max():
        x = np.linspace(-8, 8, 65)
        return Isotonic(x, sigmoid(x))
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, count, sum of scores
    for r, t in zip(raw[order].tolist(), y[order].astype(float).tolist()):
        pools.append([t, 1.0, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a)]
    s = np.array(pools)
    return Isotonic(s[:, 2] / s[:, 1], np.clip((s[:, 0] + 1e-3) / (s[:, 1] + 2e-3), 0, 1))
