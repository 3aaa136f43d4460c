"""Gradient-boosted trees of fixed depth as flat node arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node k of a tree has children 2k+1 and 2k+2; the last level holds the values.

    feature, threshold: (trees, 2 ** depth - 1); value: (trees, 2 ** depth).
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


#: Bins of a feature at most.
BINS = 64


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every number; a line for each feature."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8)


@dataclass
class Grown:
    """Trees while they grow: the bins that splits cut after, beside the nodes of ``Forest``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def places(self, codes: np.ndarray, tree: int, levels: int) -> np.ndarray:
        place, rows, feature, cut = np.zeros(codes.shape[1], dtype=np.intp), np.arange(codes.shape[1]), self.feature[tree], self.cut[tree]
        for level in range(levels):
            node = place + (2**level - 1)
            place = 2 * place + (codes[feature[node], rows] > cut[node])
        return place

    def margin(self, codes: np.ndarray, trees: int) -> np.ndarray:
        depth = self.value.shape[1].bit_length() - 1
        out = np.full(codes.shape[1], self.start)
        for t in range(trees):
            out += self.value[t][self.places(codes, t, depth)]
        return out

    def sums(self, codes: np.ndarray, y: np.ndarray, tree: int, level: int) -> np.ndarray:
        """(gradient and hessian, nodes of the level, features, bins), summed over rows."""
        p = 1 / (1 + np.exp(-self.margin(codes, tree)))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        size, base = 2**level * BINS, self.places(codes, tree, level) * BINS
        return np.stack([np.stack([np.bincount(base + line, part, size).reshape(-1, BINS) for line in codes], axis=1)
                         for part in (grad, hess)])


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = BINS, leaf: float = 1.0, ridge: float = 1.0) -> Forest:
    """Logistic boosting on binned features, of rows in memory; see ``grow``."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = codes_of(x, edges)
    return grow(edges, signs, float(y.mean()), lambda g, t, level: g.sums(codes, y, t, level), trees, depth, rate, leaf, ridge)[0]


def grow(edges: list[np.ndarray], signs: np.ndarray, mean: float, sums, trees: int = 60, depth: int = 3, rate: float = 0.2,
         leaf: float = 1.0, ridge: float = 1.0) -> tuple[Forest, Grown]:
    """Logistic boosting from histograms: ``sums(grown, tree, level)`` gives ``Grown.sums`` of all rows.

    signs: for each feature 1 (score never falls as it grows), -1 (never rises) or 0. A split
    on a constrained feature that would break its sign is refused, and the midpoint of its two
    values bounds everything below it, so the constraint holds for whole trees and their sum.
    """
    rate_of = min(max(mean, 1e-4), 1 - 1e-4)
    inner = 2**depth - 1
    grown = Grown(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), BINS), np.zeros((trees, inner + 1)),
                  float(np.log(rate_of / (1 - rate_of))))
    thresholds = np.full((trees, inner), np.inf)
    for t in range(trees):
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        below = np.zeros((2 * inner + 1, 2))
        for level in range(depth):
            grads, hessians = sums(grown, t, level)
            for i in range(2**level):
                k = 2**level - 1 + i
                feature, threshold, best = 0, np.inf, 1e-9
                low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
                g_all, h_all = grads[i, 0].sum(), hessians[i, 0].sum()
                below[2 * k + 1] = g_all, h_all
                for j in range(len(edges) if h_all > 0 else 0):
                    g, h = (np.cumsum(part[i, j])[:len(edges[j])] for part in (grads, hessians))
                    left = np.clip(g / (h + ridge), low[k], high[k])
                    right = np.clip((g_all - g) / (h_all - h + ridge), low[k], high[k])
                    gain = _gain(left, g, h + ridge) + _gain(right, g_all - g, h_all - h + ridge)
                    fine = (h >= leaf) & (h_all - h >= leaf) & (signs[j] * (right - left) >= 0)
                    gain = np.where(fine, gain - _gain(np.clip(g_all / (h_all + ridge), low[k], high[k]), g_all, h_all + ridge), 0)
                    if len(gain) and gain.max() > best:
                        cut = int(gain.argmax())
                        best, feature, threshold = float(gain[cut]), j, float(edges[j][cut])
                        chosen = signs[j], (left[cut] + right[cut]) / 2
                        grown.cut[t, k] = cut
                        below[2 * k + 1], below[2 * k + 2] = (g[cut], h[cut]), (g_all - g[cut], h_all - h[cut])
                if threshold < np.inf and chosen[0]:
                    under, over = (2 * k + 1, 2 * k + 2) if chosen[0] > 0 else (2 * k + 2, 2 * k + 1)
                    high[under], low[over] = min(high[under], chosen[1]), max(low[over], chosen[1])
                grown.feature[t, k], thresholds[t, k] = feature, threshold
        value = np.clip(below[inner:, 0] / (below[inner:, 1] + ridge), low[inner:], high[inner:])
        grown.value[t] = np.where(np.isfinite(value), rate * value, 0.0)
    return Forest(grown.feature, thresholds, grown.value, grown.start), grown


def _gain(value, g, h):
    return value * g - value * value * h / 2
