"""Gradient-boosted trees and isotonic calibration in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = self.feature[node]
            node = 2 * node + 1 + (x[np.arange(len(x)), f] > self.edge[node])
        return self.value[node - (2**self.depth - 1)]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    x_cal: np.ndarray
    y_cal: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, self.x_cal, self.y_cal) if len(self.x_cal) else 1 / (1 + np.exp(-m))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of ``y`` on ``score`` (pool adjacent violators); tied scores are pooled first."""
    w = np.ones(len(y)) if weight is None else weight
    s, at = np.unique(score, return_inverse=True)
    wt = np.bincount(at, weights=w)
    mean = np.bincount(at, weights=w * y) / wt
    level: list[list[float]] = []
    for k in range(len(s)):
        level.append([mean[k], wt[k], s[k], s[k]])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            m, v, _, hi = level.pop()
            p = level[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * v) / (p[1] + v), p[1] + v, hi
    xs = np.array([x for p in level for x in (p[2], p[3])])
    ys = np.array([p[0] for p in level for _ in range(2)])
    return xs, ys


def _fit_tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, rate: float) -> tuple[Tree, np.ndarray]:
    n, m = bins.shape
    feature, edge = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
    node = np.zeros(n, dtype=np.int64)
    for d in range(depth):
        first, width = 2**d - 1, 2**d
        local = node - first
        best = np.full(width, 1e-6)
        split = [(0, 255)] * width
        for f in range(m):
            if not len(edges[f]):
                continue
            k = len(edges[f]) + 1
            key = local * k + bins[:, f]
            gs = np.bincount(key, weights=g, minlength=width * k).reshape(width, k).cumsum(axis=1)
            hs = np.bincount(key, weights=h, minlength=width * k).reshape(width, k).cumsum(axis=1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain = np.where((hs < 1) | (ht - hs < 1), 0, gain)[:, :-1]
            top = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(width), top] > best):
                best[i], split[i] = gain[i, top[i]], (f, int(top[i]))
        for i, (f, c) in enumerate(split):
            feature[first + i] = f
            if c < 255:
                edge[first + i] = edges[f][c]
        chosen, at = np.array([s[0] for s in split]), np.array([s[1] for s in split])
        right = bins[np.arange(n), chosen[local]] > at[local]
        node = 2 * node + 1 + right
    leaf = node - (2**depth - 1)
    gl, hl = np.bincount(leaf, weights=g, minlength=2**depth), np.bincount(leaf, weights=h, minlength=2**depth)
    value = -rate * gl / (hl + l2)
    return Tree(feature, edge, value, depth), value[leaf]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, bins: int = 32) -> Boosted:
    """Logistic loss, quantile histograms, second-order leaves. ``y`` has both classes."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree, step = _fit_tree(binned, edges, q - y, np.maximum(q * (1 - q), 1e-9), depth, l2, rate)
        trees.append(tree)
        margin += step
    return Boosted(base, trees, np.zeros(0), np.zeros(0))
