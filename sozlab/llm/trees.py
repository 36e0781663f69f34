"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """A complete tree of fixed depth: a feature and a threshold per inner node, a value per leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(node) and node[0] < len(self.features):
            node = 2 * node + 1 + (x[rows, self.features[node]] > self.thresholds[node])
        return node - len(self.features)


@dataclass
class BoostedTrees:
    """Logistic gradient boosting: shrunk Newton steps, histogram splits, trees of one depth."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    penalty: float = 1.0
    least: float = 0.2
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            margin += tree.values[tree.leaf(x)]
            self.trees.append(tree)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> Tree:
        inner = 2**self.depth - 1
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(slope), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            local, best = node - first, np.zeros(width)
            cuts = np.full(width, -1)
            for f, edge in enumerate(edges):
                cells = local * BINS + binned[:, f]
                g = np.bincount(cells, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cells, curve, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gain = self._gain(g, h, g[:, -1:], h[:, -1:])[:, : len(edge)]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best + 1e-12
                best = np.where(better, gain[np.arange(width), at], best)
                cuts = np.where(better, at, cuts)
                features[first : first + width][better] = f
            for n in range(width):
                if cuts[n] >= 0:
                    thresholds[first + n] = edges[features[first + n]][cuts[n]]
            split = np.where(cuts[local] >= 0, binned[np.arange(len(node)), features[node]] > cuts[local], False)
            node = 2 * node + 1 + split
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, curve, inner + 1)
        return Tree(features, thresholds, -self.rate * g / (h + self.penalty))

    def _gain(self, g, h, all_g, all_h):
        def score(a, b):
            return a * a / (b + self.penalty)

        gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
        return np.where((h >= self.least) & (all_h - h >= self.least), gain, -1.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.values[tree.leaf(x)]
        return out


@dataclass
class Isotonic:
    """The nondecreasing step function closest to the labels, interpolated between its steps."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        # equal margins are one block from the start: no order of theirs counts
        margins, place = np.unique(margin, return_inverse=True)
        labels, weights = np.bincount(place, y, len(margins)), np.bincount(place, minlength=len(margins))
        blocks: list[list[float]] = []  # sum of labels, weight, sum of margins
        for m, label, w in zip(margins, labels, weights):
            blocks.append([float(label), float(w), float(m * w)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
        weight = np.array([b[1] for b in blocks])
        # half a label of each kind per block keeps scores off 0 and 1 and the order strict
        value = (np.array([b[0] for b in blocks]) + 0.5) / (weight + 1)
        return cls(np.array([b[2] for b in blocks]) / weight, np.maximum.accumulate(value))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)
