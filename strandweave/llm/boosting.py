"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Second-order boosting of complete binary trees over quantile bins, log loss."""

    def __init__(self, n_trees: int = 80, depth: int = 3, rate: float = 0.15, least: float = 3.0, penalty: float = 1.0, n_bins: int = 48):
        self.n_trees, self.depth, self.rate, self.least, self.penalty, self.n_bins = n_trees, depth, rate, least, penalty, n_bins
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        rows, width = x.shape
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        flat = bins + np.arange(width) * self.n_bins
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(rows, self.start)
        size = width * self.n_bins
        for _ in range(self.n_trees):
            p = sigmoid(raw)
            g, h = p - y, p * (1 - p)
            node = np.zeros(rows, np.int64)
            feature = np.zeros(2 ** self.depth - 1, np.int64)
            threshold = np.full(2 ** self.depth - 1, np.inf)
            for level in range(self.depth):
                n_nodes = 2 ** level
                at = (node[:, None] * size + flat).ravel()
                sums = [np.bincount(at, np.repeat(v, width), n_nodes * size).reshape(n_nodes, width, self.n_bins) for v in (g, h)]
                left_g, left_h = (s.cumsum(2) for s in sums)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g ** 2 / (left_h + self.penalty) + right_g ** 2 / (right_h + self.penalty) - all_g ** 2 / (all_h + self.penalty)
                gain[(left_h < self.least) | (right_h < self.least)] = 0
                best = gain.reshape(n_nodes, -1).argmax(1)
                f, b = best // self.n_bins, best % self.n_bins
                useful = gain.reshape(n_nodes, -1).max(1) > 1e-9
                for k in range(n_nodes):
                    slot = n_nodes - 1 + k
                    feature[slot] = f[k]
                    if useful[k] and b[k] < len(edges[f[k]]):
                        threshold[slot] = edges[f[k]][b[k]]
                slot = n_nodes - 1 + node
                node = node * 2 + (x[np.arange(rows), feature[slot]] > threshold[slot])
            leaf_g, leaf_h = (np.bincount(node, v, 2 ** self.depth) for v in (g, h))
            leaf = -self.rate * leaf_g / (leaf_h + self.penalty)
            raw += leaf[node]
            self.trees.append((feature, threshold, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                slot = 2 ** level - 1 + node
                node = node * 2 + (x[row, feature[slot]] > threshold[slot])
            out += leaf[node]
        return out


class Isotonic:
    """Pooled adjacent violators; between the pools' centres the curve is linear."""

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, sum of raw values
        for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([v, 1.0, r])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
        # half a row of each class keeps the ends off 0 and 1
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.maximum.accumulate(np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools]))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


class Calibrated:
    """Trees on all rows, calibrated on predictions out of fold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = 5):
        self.constant = None
        if len(y) < 10 or y.min() == y.max():
            self.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
            return
        part = np.arange(len(y)) % folds
        held = np.zeros(len(y))
        for k in range(folds):
            held[part == k] = BoostedTrees().fit(x[part != k], y[part != k]).raw(x[part == k])
        self.trees = BoostedTrees().fit(x, y)
        self.curve = Isotonic(held, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else self.curve(self.trees.raw(x))
