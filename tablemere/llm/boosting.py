"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node k of a tree goes to 2k+1 or, above its threshold, to 2k+2.

    ``feature`` and ``threshold`` are (trees, 2**depth - 1), ``value`` is (trees, 2**depth).
    A node that wasn't split has threshold infinity.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows walk down a tree together."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0, ridge: float = 1.0
) -> Forest:
    """Fit on rows ``x`` and labels ``y`` in {0, 1} by second-order logistic boosting on binned features.

    Rows may be none or of one label: the forest then gives the base rate, kept
    off 0 and 1 by one row of either label. Not-a-number counts as the least value.
    """
    x = np.nan_to_num(np.asarray(x, np.float64), nan=-np.inf, posinf=np.finfo(float).max)
    y = np.asarray(y, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Forest(base, feature[:0], threshold[:0], value[:0])
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[np.isfinite(x[:, k]), k], np.linspace(0, 1, BINS)[1:-1])) if np.isfinite(x[:, k]).any() else np.zeros(0) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    offset = np.arange(width) * BINS
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * BINS) + offset + binned).ravel()
            shape = (count, width, BINS)
            g = np.bincount(slot, np.repeat(grad, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hess, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for n in np.flatnonzero(flat.max(axis=1) > 1e-9):
                k, b = divmod(int(best[n]), BINS)
                if b < len(edges[k]):
                    feature[t, first + n], threshold[t, first + n] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = -rate * g / (h + ridge)
        margin += value[t][leaf]
    return Forest(base, feature, threshold, value)
