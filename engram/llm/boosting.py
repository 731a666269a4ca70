"""Gradient-boosted regression trees on binned dense features, and isotonic calibration; numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Trees of one depth, each an implicit heap of splits (feature, threshold) and leaf values."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, least: int = 4) -> Trees:
    """Boost on the logistic loss with second-order leaf values."""
    share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, k = x.shape
    flat = binned + np.arange(k) * BINS
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first) * k * BINS)[:, None] + flat
            size = width * k * BINS
            sums = [np.bincount(at.ravel(), np.repeat(v, k), size).reshape(width, k, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
            total = [s[:, :1, -1:] for s in sums]
            gain = sums[0] ** 2 / (sums[1] + ridge) + (total[0] - sums[0]) ** 2 / (total[1] - sums[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(sums[2] < least) | (total[2] - sums[2] < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for w in range(width):
                c, b = divmod(int(best[w]), BINS)
                if gain[w, c, b] > 1e-9 and b < len(edges[c]):
                    f[first + w], t[first + w] = c, edges[c][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - (2**depth - 1)
        value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge) * rate
        score += value[leaf]
        model.features.append(f)
        model.thresholds.append(t)
        model.leaves.append(value)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to shares of label 1, linear between its points."""

    at: np.ndarray
    share: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.share)


def calibrate(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators, with half a row of each label added to every end block."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for r, v in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    share = np.array([(s + 0.5 * float(y.mean())) / (n + 0.5) for s, n, _ in blocks])
    return Isotonic(np.array([c / n for _, n, c in blocks]), np.maximum.accumulate(np.clip(share, 0, 1)))
