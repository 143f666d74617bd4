"""Gradient-boosted trees for a yes-no question, on binned features (logistic loss)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: node k of a tree has children 2k+1 and 2k+2."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, least: float = 2.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge, self.least = n_trees, depth, rate, bins, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int16)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], "right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b, (n, p) = self._binned(x), x.shape
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.n_trees, inner), np.int16)
        self.split = np.full((self.n_trees, inner), self.bins, np.int16)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        f = np.full(n, self.base)
        cell = b.astype(np.int64) + np.arange(p) * self.bins
        for t in range(self.n_trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = (cell + (node - first)[:, None] * (p * self.bins)).ravel()
                size = width * p * self.bins
                gs = np.bincount(at, np.repeat(g, p), size).reshape(width, p, self.bins).cumsum(2)
                hs = np.bincount(at, np.repeat(h, p), size).reshape(width, p, self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                self.feature[t, first : first + width] = best // self.bins
                self.split[t, first : first + width] = np.where(useful, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(n), self.feature[t, node]] > self.split[t, node])
            leaf = node - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.leaf[t] = self.rate * value
            f += self.leaf[t][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.split[t, node])
            out += self.leaf[t][node - (2**self.depth - 1)]
        return out
