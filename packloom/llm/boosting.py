"""Gradient-boosted regression trees for a logistic loss, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Complete trees of a fixed depth: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, depth: int = 4):
        self.depth, self.bias = depth, 0.0
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.25, l2: float = 2.0, least: float = 4.0) -> Boosted:
        """Level by level, by exact sums over bins; a feature of two values needs one sum, a matrix product."""
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        low, high = x.min(0), x.max(0)
        two = np.array([bool(((x[:, f] == low[f]) | (x[:, f] == high[f])).all()) for f in range(width)])
        pairs, many = np.flatnonzero(two), np.flatnonzero(~two)
        above = (x[:, pairs] > low[pairs]).astype(np.float32)
        bins = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in many]) if len(many) else np.zeros((n, 0), np.int64)
        flat = bins + np.arange(len(many)) * BINS
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        z = np.full(n, self.bias)
        inner = 2**self.depth - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            place = np.zeros(n, np.int64)  # within the level
            for level in range(self.depth):
                nodes, first = 2**level, 2**level - 1
                total = np.stack([np.bincount(place, v, nodes) for v in (g, h)])
                spread = np.zeros((n, 2 * nodes), np.float32)
                spread[np.arange(n), place], spread[np.arange(n), place + nodes] = g, h
                up = (above.T @ spread).reshape(len(pairs), 2, nodes).transpose(1, 2, 0).astype(float)
                left2 = total[:, :, None] - up  # (g and h, node, feature)
                where = (flat + place[:, None] * (len(many) * BINS)).ravel()
                size = nodes * len(many) * BINS
                left = np.stack([np.bincount(where, np.repeat(v, len(many)), size).reshape(nodes, len(many), BINS).cumsum(2) for v in (g, h)])
                sums = np.concatenate((left.reshape(2, nodes, -1), left2), 2)
                rest = total[:, :, None] - sums
                gain = sums[0] ** 2 / (sums[1] + l2) + rest[0] ** 2 / (rest[1] + l2) - (total[0] ** 2 / (total[1] + l2))[:, None]
                gain[(sums[1] < least) | (rest[1] < least)] = -1
                for k, best in enumerate(gain.argmax(1)):
                    f, b = divmod(int(best), BINS) if best < len(many) * BINS else (None, int(best) - len(many) * BINS)
                    if gain[k, best] <= 1e-6 or (f is not None and b >= len(cuts[many[f]])):
                        continue
                    feature[first + k] = many[f] if f is not None else pairs[b]
                    cut[first + k] = cuts[many[f]][b] if f is not None else low[pairs[b]]
                place = 2 * place + (x[np.arange(n), feature[first + place]] > cut[first + place])
            value = np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + l2) * rate
            z += value[place]
            self.feature.append(feature)
            self.cut.append(cut.astype(np.float32))
            self.leaf.append(value)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            z += leaf[k - len(feature)]
        return 1 / (1 + np.exp(-z))
