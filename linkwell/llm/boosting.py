"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; a row goes right if its bin exceeds ``cut``."""

    edges: list[np.ndarray]
    depth: int
    start: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(x):
            return out
        b, rows = self.bins(x), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, most_bins: int = 32, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss.  ``least``: smallest sum of second derivatives in a leaf."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(edges, depth, float(np.log(share / (1 - share))))
    b, n, width = model.bins(x).astype(np.int64), x.shape[1], most_bins
    logit = np.full(len(x), model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * n + np.arange(n)) * width + b
            sums = [np.bincount(at.ravel(), np.repeat(v, n), many * n * width).reshape(many, n, width).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            flat = gain.reshape(many, -1)
            best = flat.argmax(1)
            good = flat[np.arange(many), best] > 1e-6
            feature[first : first + many] = np.where(good, best // width, 0)
            cut[first : first + many] = np.where(good, best % width, width)
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        logit += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model
