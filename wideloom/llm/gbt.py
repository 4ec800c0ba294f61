"""Histogram gradient-boosted trees, trained on a bounded sample and flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node ``i`` has the children ``2i+1`` and ``2i+2``."""
    base: float
    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a value above it goes right
    leaf: np.ndarray       # (trees, leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows step through all trees at once, one level at a time."""
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1)) if inner else 0
        rows = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        if len(self.feature) and len(x):
            at = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(depth):
                right = x[rows, self.feature[tree, at]] > self.threshold[tree, at]
                at = 2 * at + 1 + right
            total = total + self.leaf[tree, at - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, min_rows: float = 10.0) -> Trees:
    """Logistic loss, second-order gains from gradient histograms; without both labels a constant."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    inner, share = 2 ** depth - 1, float(y.mean()) if n else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if n == 0 or len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    cuts = np.full((width, bins), np.inf)
    for j, e in enumerate(edges):
        cuts[j, :len(e)] = e
    features, thresholds, leaves = [], [], []
    raw, column = np.full(n, base), np.arange(width)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at, split_bin = np.zeros(n, np.int64), np.full(inner, bins)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            slot = (((at - first)[:, None] * width + column) * bins + binned).ravel()
            size = count * width * bins
            gs, hs, ns = (np.cumsum(np.bincount(slot, np.repeat(w, width), size).reshape(count, width, bins), 2)
                          for w in (g, h, np.ones(n)))
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs ** 2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt ** 2 / (ht + l2)
            gain[(ns < min_rows) | (nt - ns < min_rows)] = -1
            best = gain.reshape(count, -1).argmax(1)
            won = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            node = first + np.arange(count)
            feature[node] = np.where(won, best // bins, 0)
            split_bin[node] = np.where(won, best % bins, bins)
            threshold[node] = np.where(won, cuts[best // bins, np.minimum(best % bins, bins - 1)], np.inf)
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split_bin[at])
        gl, hl = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -rate * gl / (hl + l2)
        raw += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(leaves))
