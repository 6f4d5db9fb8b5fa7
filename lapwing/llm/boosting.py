"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: split features and thresholds by tree and node, leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; each level's splits come from histograms of gradients."""
    x = x.astype(np.float32)
    weight = np.ones(len(x)) if weight is None else weight
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    f = np.full(len(x), base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf, dtype=np.float32), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            own = at - first
            best, pick = np.full(n, 1e-6), [(0, np.inf)] * n
            for j, b in enumerate(binned):
                if not len(edges[j]):
                    continue
                k = own * bins + b
                gs, hs = (np.cumsum(np.bincount(k, weights=v, minlength=n * bins).reshape(n, bins), axis=1) for v in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                gain = gain[:, : len(edges[j])]
                top = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(n), top] > best):
                    best[node], pick[node] = gain[node, top[node]], (j, edges[j][top[node]])
            for node, (j, cut) in enumerate(pick):
                feature[t, first + node], threshold[t, first + node] = j, cut
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > threshold[t, at])
        own = at - inner
        gs, hs = np.bincount(own, weights=g, minlength=leaves), np.bincount(own, weights=h, minlength=leaves)
        leaf[t] = rate * np.clip(gs / (hs + l2), -4, 4)
        f += leaf[t][own]
    return Boosted(base, feature, threshold, leaf)
