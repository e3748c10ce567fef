"""Gradient-boosted regression trees on the logistic loss, over features cut into at most 32 bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: per tree and inner node a feature and the bin up to which rows go left."""

    edges: tuple
    base: float
    split: np.ndarray  # (trees, inner nodes, 2)
    leaf: np.ndarray  # (trees, leaves)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 0).astype(np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for split, leaf in zip(self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[split[node, 0], rows] > split[node, 1])
            out += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    """Second-order boosting: each tree takes, level by level, the split of every node with the largest gain."""
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > 32:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:]))
        edges.append(values[:-1])
    rows, n_bins = np.arange(len(x)), 32
    model = Trees(tuple(edges), float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight)))), np.zeros((0, 0, 2)), np.zeros((0, 2**depth)))
    b = model.binned(x).astype(np.int64)
    score, splits, leaves = np.full(len(x), model.base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        split, node = np.zeros((2**depth - 1, 2), np.int64), np.zeros(len(x), np.int64)
        split[:, 1] = n_bins  # no split: all rows go left
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = node - first
            gain_of, best = np.zeros(width), np.zeros((width, 2), np.int64)
            best[:, 1] = n_bins
            for j in range(x.shape[1]):
                at = place * n_bins + b[j]
                gs = np.bincount(at, g, width * n_bins).reshape(width, n_bins).cumsum(1)
                hs = np.bincount(at, h, width * n_bins).reshape(width, n_bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                better = top > gain_of + 1e-9
                gain_of[better] = top[better]
                best[better] = np.stack([np.full(width, j), cut], 1)[better]
            split[first : first + width] = best
            node = 2 * node + 1 + (b[split[node, 0], rows] > split[node, 1])
        place = node - (2**depth - 1)
        gs, hs = np.bincount(place, g, 2**depth), np.bincount(place, h, 2**depth)
        leaf = -rate * gs / (hs + ridge)
        score += leaf[place]
        splits.append(split)
        leaves.append(leaf)
    return Trees(model.edges, model.base, np.array(splits), np.array(leaves))
