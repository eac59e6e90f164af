"""Gradient-boosted trees with monotonic constraints: trained with numpy on a bounded sample, scored over flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays. A node's children are at left and left + 1; a leaf points to itself and holds a value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row; a step down one level is one vector operation over all rows and trees."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.feature[at] < 0
            down = self.left[at] + (x[row, np.maximum(self.feature[at], 0)] > self.threshold[at])
            at = np.where(leaf, at, down)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """monotone: for each feature -1, 0 or 1, the sign that the score's change with the feature must have.

    A split on a constrained feature is taken only if its two sides' values are in that order, and bounds at their middle hold
    for all that is below, so the whole tree is monotonic. A set with one class gives a constant.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def node(v: float) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        value.append(v)
        return len(value) - 1

    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    margin = np.full(len(x), base)
    if len(np.unique(y)) < 2:
        trees = 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        roots.append(node(0.0))
        work = [(roots[-1], np.arange(len(x)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[at] = float(rate * np.clip(g / (h + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    n = len(c) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[rows], hess[rows], None))
                    gr, hr, nr = g - gl, h - hl, len(rows) - nl
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + gr * vr - (hr + ridge) * vr**2 / 2
                    gain -= g * np.clip(g / (h + ridge), low, high) - (h + ridge) * np.clip(g / (h + ridge), low, high) ** 2 / 2
                    gain[(nl < least) | (nr < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                margin[rows] += value[at]
                continue
            j, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            under, over = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
            feature[at], threshold[at] = j, float(cuts[j][k])
            left[at] = node(0.0)
            node(0.0)
            goes = binned[rows, j] <= k
            work += [(left[at], rows[goes], level + 1, *under), (left[at] + 1, rows[~goes], level + 1, *over)]
    return Forest(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), depth, base)
