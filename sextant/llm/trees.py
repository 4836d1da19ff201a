"""Gradient-boosted trees with monotonic constraints, trained and scored in numpy.

Training grows depth-limited trees on binned features for the logistic loss.  A feature
with constraint +1 or -1 only takes splits whose children's values are in that order, and
a split's middle value bounds everything below it, so the whole score is monotonic in the
feature.  A trained model is flat arrays of nodes; scoring moves all rows down one level
of all trees at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node i of tree t: feature < 0 marks a leaf, which points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values of each row; its logistic function is the probability."""
        n, t = len(x), len(self.feature)
        at = np.zeros((n, t), np.int64)
        trees, rows = np.arange(t)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, at]
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[trees, at]
            below = np.where(goes_left, self.left[trees, at], self.right[trees, at])
            at = np.where(f < 0, at, below)
        return self.bias + self.value[trees, at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 8) -> Trees:
    """x: rows by features; y: 0 or 1; monotone: -1, 0 or 1 per feature."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score = np.full(n, bias)
    size = 2 ** (depth + 1) - 1
    shape = (rounds, size)
    out = Trees(np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape), depth, bias)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for i in range(size):
            rows = np.flatnonzero(node == i)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            out.value[t, i] = rate * np.clip(-gs / (hs + ridge), low[i], high[i])
            if 2 * i + 2 >= size or len(rows) < 2 * least:
                continue
            best = (1e-6, 0, 0, 0.0, 0.0)
            for j in range(m):
                k = len(edges[j]) + 1
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], k))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
                vl = np.clip(-gl / (hl + ridge), low[i], high[i])
                vr = np.clip(-(gs - gl) / (hs - hl + ridge), low[i], high[i])
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * monotone[j] < 0)
                gain = np.where(bad, -np.inf, gain)
                if len(gain) and gain.max() > best[0]:
                    c = int(gain.argmax())
                    best = (gain[c], j, c, vl[c], vr[c])
            if best[0] <= 1e-6:
                continue
            _, j, c, vl, vr = best
            a, z = 2 * i + 1, 2 * i + 2
            out.feature[t, i], out.threshold[t, i], out.left[t, i], out.right[t, i] = j, edges[j][c], a, z
            low[a] = low[z] = low[i]
            high[a] = high[z] = high[i]
            if monotone[j]:
                upper, lower = (z, a) if monotone[j] > 0 else (a, z)
                low[upper] = high[lower] = (vl + vr) / 2
            node[rows] = np.where(binned[rows, j] <= c, a, z)
        score += out.value[t, node]
    return out
