"""Small gradient-boosted trees for binary labels, in numpy: histogram splits, logistic loss, per-group calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees held as arrays (feature, threshold, left, right, value); prediction is vectorised."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.bias)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree, out = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            score += out
        return self

    def _grow(self, binned, edges, grad, hess):
        nodes, out = [], np.zeros(len(grad))
        todo = [(np.arange(len(grad)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(nodes)
            g, h = grad[rows].sum(), hess[rows].sum()
            value = self.rate * g / (h + self.l2)
            nodes.append([-1, 0.0, -1, -1, value])
            if parent >= 0:
                nodes[parent][2 + side] = me
            best = (1e-6, -1, 0)
            if depth < self.depth and len(rows) >= 8:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
                    gain = gs**2 / (hs + self.l2) + (g - gs) ** 2 / (h - hs + self.l2) - g**2 / (h + self.l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] < 0:
                out[rows] = value
                continue
            _, j, k = best
            nodes[me][:2] = [j, float(edges[j][k])]
            left = binned[rows, j] <= k
            todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
        return [np.array(c) for c in zip(*nodes, strict=True)], out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The score from which the kept rows have the precision asked for, half way to the first row that is not kept; 1.01
    where none has."""
    order = np.argsort(-p, kind="stable")
    ok = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    last = np.ones(len(ok), bool)
    last[:-1] = p[order][:-1] != p[order][1:]
    at = np.flatnonzero(ok & last)
    if not len(at):
        return 1.01
    last = int(at[-1])
    return float(p[order][last : last + 2].mean())
