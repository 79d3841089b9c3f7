"""Histogram gradient-boosted trees for two classes, on the driver, over a bounded table of binned rows.

The fitted model is a few flat arrays: trees are complete binary trees of one depth, node k has the
children 2k + 1 and 2k + 2, and a row goes right where its bin is above the node's cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    prior: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a bin
    leaf: np.ndarray  # trees x leaves

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Log odds of each row of bins; all trees go down one level at a time."""
        n, trees = len(bins), len(self.leaf)
        node = np.zeros((n, trees), np.int64)
        each, rows = np.arange(trees)[None, :], np.arange(n)[:, None]
        for _ in range(self.depth):
            right = bins[rows, self.feature[each, node]] > self.cut[each, node]
            node = 2 * node + 1 + right
        return self.prior + self.leaf[each, node - self.feature.shape[1]].sum(axis=1)

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bins), -30, 30)))


def fit(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, smooth: float = 1.0, least: float = 4.0) -> Trees:
    """Newton boosting of the logistic loss. bins: small non-negative ints, a row per example."""
    n, width = bins.shape
    size = int(bins.max(initial=0)) + 1
    total = max(weight.sum(), 1e-9)
    share = np.clip((label * weight).sum() / total, 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), size, np.int64), np.zeros((trees, leaves))
    raw = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = (label - p) * weight, p * (1 - p) * weight
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = node - first
            gain = np.zeros((wide, width, size))
            for f in range(width):
                key = at * size + bins[:, f]
                G, H, N = (np.bincount(key, x, wide * size).reshape(wide, size).cumsum(axis=1) for x in (g, h, weight))
                gl, hl, nl = G, H, N
                gr, hr, nr = G[:, -1:] - G, H[:, -1:] - H, N[:, -1:] - N
                got = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - G[:, -1:] ** 2 / (H[:, -1:] + smooth)
                gain[:, f] = np.where((nl >= least) & (nr >= least), got, 0)
            best = gain.reshape(wide, -1).argmax(axis=1)
            useful = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            feature[t, first : first + wide] = np.where(useful, best // size, 0)
            cut[t, first : first + wide] = np.where(useful, best % size, size)
            node = 2 * node + 1 + (bins[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + smooth)
        raw += leaf[t][at]
    return Trees(prior, feature, cut, leaf)
