"""Small learners over a bounded table of dense features: boosted trees, isotonic steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Tree:
    """A tree as arrays: feature (-1 at leaves), threshold, left child (right is next), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[node]
            right = x[rows, np.maximum(feature, 0)] > self.threshold[node]
            node = np.where(inner, self.left[node] + right, node)


def _grow(x, binned, edges, gradient, hessian, depth, ridge, least) -> Tree:
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, level = open_nodes.pop()
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        value[node] = -total_g / (total_h + ridge)
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                width = len(edges[f]) + 1
                if width == 1:
                    continue
                bins = binned[rows, f]
                left_g = np.bincount(bins, g, width).cumsum()[:-1]
                left_h = np.bincount(bins, h, width).cumsum()[:-1]
                left_n = np.bincount(bins, minlength=width).cumsum()[:-1]
                gain = (
                    left_g**2 / (left_h + ridge)
                    + (total_g - left_g) ** 2 / (total_h - left_h + ridge)
                    - total_g**2 / (total_h + ridge)
                )
                gain[(left_n < least) | (len(rows) - left_n < least)] = -np.inf
                cut = int(gain.argmax())
                if gain[cut] > best[0]:
                    best = (gain[cut], f, cut)
        if best[1] is None:
            continue
        _, f, cut = best
        goes_right = binned[rows, f] > cut
        feature[node], threshold[node], left[node] = f, edges[f][cut], len(feature)
        for part in (rows[~goes_right], rows[goes_right]):
            open_nodes.append((len(feature), part, level + 1))
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(value))


@dataclass(frozen=True)
class BoostedTrees:
    """Additive trees for the log-odds of a binary label."""

    base: float
    rate: float
    trees: tuple[Tree, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15,
          ridge: float = 1.0, least: int = 3) -> BoostedTrees:
    """Newton boosting of the logistic loss over quantile bins of every feature."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.empty(0) for f in range(x.shape[1])]
    # The largest value is no cut, since nothing lies above it.
    edges = [e[e < x[:, f].max()] if len(x) else e for f, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    model, score = [], np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, binned, edges, p - y, p * (1 - p), depth, ridge, least)
        model.append(tree)
        score = score + rate * tree.predict(x)
    return BoostedTrees(base, rate, tuple(model))


@dataclass(frozen=True)
class Isotonic:
    """A rising step function, drawn with straight lines between the steps' middles."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.clip(score, 0.0, 1.0)
        return np.interp(score, self.at, self.value)


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; every pool's share is drawn in a little from 0 and 1."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # positives, rows, sum of scores
    for s, label in zip(score[order], y[order]):
        pools.append([float(label), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return Isotonic(np.empty(0), np.empty(0))
    table = np.array(pools)
    value = np.maximum.accumulate((table[:, 0] + 0.25) / (table[:, 1] + 0.5))
    return Isotonic(table[:, 2] / table[:, 1], value)
