"""Gradient-boosted regression trees for a binary label, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: per tree the feature and threshold of each inner node (in level
    order) and the value of each leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), int)
            while node.size and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss. All nodes of a level are split at once from
    histograms of gradients by (node, feature, bin)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, m = x.shape
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    feats, cuts, values = [], [], []
    offset = np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, f, t = np.zeros(n, int), np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * m * bins + offset + binned).ravel()
            sums = [np.bincount(cell, np.repeat(w, m), many * m * bins).reshape(many, m, bins).cumsum(2) for w in (g, h)]
            total = [s[:, :1, -1:] for s in sums]
            gain = sum(a * a / (b + ridge) for a, b in ((sums[0], sums[1]), (total[0] - sums[0], total[1] - sums[1])))
            gain = (gain - total[0] ** 2 / (total[1] + ridge)).reshape(many, -1)
            best = gain.argmax(1)
            for k in range(many):
                if gain[k, best[k]] > 1e-6:
                    col, b = divmod(int(best[k]), bins)
                    f[first + k] = col
                    t[first + k] = edges[col][b] if b < len(edges[col]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - len(f)
        v = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge) * rate
        margin += v[leaf]
        feats.append(f)
        cuts.append(t)
        values.append(v)
    return Trees(start, np.array(feats), np.array(cuts, np.float32), np.array(values))
