"""Gradient-boosted regression trees for a logistic loss, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at - (2**self.depth - 1)]


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += tree.predict(x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, damp: float = 1.0) -> Boosted:
    """Second-order boosting; each feature is cut at its distinct values (64 at most)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 65), method="nearest"))[:-1] for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    rest = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rest / (1 - rest)))
    total = np.full(len(x), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            if len(mine):
                gs, hs = g[mine].sum(), h[mine].sum()
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    gl = np.cumsum(np.bincount(binned[mine, f], g[mine], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, f], h[mine], len(cuts[f]) + 1))[:-1]
                    gain = gl**2 / (hl + damp) + (gs - gl) ** 2 / (hs - hl + damp) - gs**2 / (hs + damp)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, cuts[f][k]
                at[mine] = 2 * node + 1 + (x[mine, feature[node]] > cut[node])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        value = -rate * gl / (hl + damp)
        trees.append(Tree(feature, cut, value, depth))
        total += value[leaf]
    return Boosted(base, tuple(trees))


def threshold_at(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score at and above which the share of positives reaches ``precision``."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[scores[order][1:] < scores[order][:-1], True]
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else 1.1
