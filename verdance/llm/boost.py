"""Gradient-boosted trees over a small dense table, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; value at the leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes; -1: all rows go left
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                right = (f[node] >= 0) & (x[rows, np.maximum(f[node], 0)] > t[node])
                node = 2 * node + 1 + right
            out += v[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: float = 8.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])
    mean = min(max(float(np.average(y, weights=w)), 1e-4), 1 - 1e-4)
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    raw = np.full(n, base)
    feature, threshold, value = np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            go = np.zeros(len(rows), bool)
            if len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = 1e-6
                for j in range(k):
                    size = len(cuts[j]) + 1
                    sg = np.cumsum(np.bincount(code[rows, j], g[rows], size))[:-1]
                    sh = np.cumsum(np.bincount(code[rows, j], h[rows], size))[:-1]
                    sn = np.cumsum(np.bincount(code[rows, j], minlength=size))[:-1]
                    if not len(sg):
                        continue
                    gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                    gain[(sn < least) | (len(rows) - sn < least)] = 0
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, feature[t, at], threshold[t, at] = gain[c], j, cuts[j][c]
                        go = code[rows, j] > c
            node[rows] = 2 * at + 1 + go
        for leaf in range(inner + 1):
            rows = node == inner + leaf
            value[t, leaf] = rate * g[rows].sum() / (h[rows].sum() + ridge)
        raw += value[t][node - inner]
    return Trees(base, feature, threshold, value)


#: Part of the way to its neighbours by which a block's fit rises, and how far the fit goes on beyond the first and last score.
SLOPE, TAIL = 0.02, 8.0


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the least-squares nondecreasing fit, by pooling adjacent violators, with ties inside a block broken by x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for i in order:
        blocks.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, v, _, last = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + m * v) / (b[1] + v)
            b[1] += v
            b[3] = last
    means = np.array([b[0] for b in blocks])
    below, above = np.concatenate([[0.0], means[:-1]]), np.concatenate([means[1:], [1.0]])
    # Inside a block the fit rises by a small part of the way from its neighbours, so that its ranking survives.
    knots_x = np.array([v for b in blocks for v in (b[2], b[3])])
    knots_y = np.stack([means - SLOPE * (means - below), means + SLOPE * (above - means)], 1).ravel()
    ends = (float(knots_y[0]) * (1 - SLOPE), float(knots_y[-1]) + SLOPE * (1 - float(knots_y[-1])))
    return np.concatenate([[knots_x[0] - TAIL], knots_x, [knots_x[-1] + TAIL]]), np.concatenate([[ends[0]], knots_y, [ends[1]]])
