"""Gradient-boosted trees with logistic loss over a small feature matrix (a bounded training sample, fitted on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Complete binary trees of one depth: a feature and a bound for each inner node, a value for each leaf."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), int)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            total += v[node - inner]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Boosted:
    """x: rows by features; y: 0 or 1. Splits are sought among quantiles; leaves are Newton steps shrunk by `rate`."""
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    inner = 2**depth - 1
    out, total = ([], [], []), np.full(len(y), base)
    for _ in range(rounds):
        p = sigmoid(total)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, bound = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut_at = np.full(width, bins + 1)
            for f, (b, c) in enumerate(zip(binned, cuts, strict=True)):
                if not len(c):
                    continue
                key, size = (node - first) * (bins + 1) + b, width * (bins + 1)
                gs = np.bincount(key, g, size).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, size).reshape(width, -1).cumsum(1)
                left, right = hs[:, : len(c)], hs[:, -1:] - hs[:, : len(c)]
                gl, gr = gs[:, : len(c)], gs[:, -1:] - gs[:, : len(c)]
                gain = gl**2 / (left + least) + gr**2 / (right + least) - gs[:, -1:] ** 2 / (hs[:, -1:] + least)
                at = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), at] > best + 1e-12)
                best[better] = gain[better, at[better]]
                feature[first + better], cut_at[better] = f, at[better]
                bound[first + better] = c[at[better]]
            local = node - first
            node = 2 * node + 1 + (binned[feature[node], np.arange(len(y))] > cut_at[local])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + least)
        total = total + value[leaf]
        for kept, made in zip(out, (feature, bound, value), strict=True):
            kept.append(made)
    return Boosted(base, *map(np.array, out))


def bound_for_precision(score: np.ndarray, y: np.ndarray, precision: float, least_rows: int = 4) -> float:
    """The lowest score bound at and above which at least `precision` of held-out rows are 1; infinite if there is none.

    It lies half-way to the next lower score, not below 0.5.
    """
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    good = np.flatnonzero(last & (hits >= precision * n) & (n >= least_rows))
    return float(max(0.5, (s[good[-1]] + s[min(good[-1] + 1, len(s) - 1)]) / 2)) if len(good) else float("inf")


#: Scores are counted in so many steps between 0 and 1.
STEPS = 10_000


def bound_of_counts(counts: dict[int, tuple[int, int]], precision: float, least_rows: int = 4) -> float:
    """As bound_for_precision, of rows and rows that are 1 by step of their scores, however many rows those are. It lies half-way to the
    upper end of the next lower step that has rows, not below 0.5."""
    rows = hits = 0
    bound = float("inf")
    order = sorted(counts, reverse=True)
    for step, lower in zip(order, [x + 1 for x in order[1:]] + order[-1:], strict=True):
        rows, hits = rows + counts[step][0], hits + counts[step][1]
        if hits >= precision * rows and rows >= least_rows:
            bound = max(0.5, (step + lower) / 2 / STEPS)
    return bound
