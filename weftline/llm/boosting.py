"""Histogram gradient-boosted trees for two classes, in numpy: fitted on the driver from a bounded sample,
flattened into arrays, and traversed for a whole batch of rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes in one set of arrays. A leaf is its own child. roots: each tree's first node."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of x: all rows walk down a tree together, level by level."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: int | None = None) -> Trees:
    """x: rows by features, finite; y: 0 or 1. Of no rows the score is 0.5; of one class, close to it.

    least: rows that a leaf has at least. The result depends on x and y only.
    """
    n, width = x.shape
    least = least or max(3, min(20, n // 200))
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    # bin b holds edges[b - 1] < x <= edges[b], so that a split after bin b is x <= edges[b]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1) if n else np.zeros((0, width), int)
    offset = binned + np.arange(width) * bins
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        todo = [(len(nodes) - 1, np.arange(n), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[node][4] = -rate * g / (h + ridge)
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                flat = offset[rows].ravel()
                size = width * bins
                gs = np.bincount(flat, np.repeat(grad[rows], width), size).reshape(width, bins).cumsum(1)
                hs = np.bincount(flat, np.repeat(hess[rows], width), size).reshape(width, bins).cumsum(1)
                ns = np.bincount(flat, minlength=size).reshape(width, bins).cumsum(1)
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                f, b = divmod(int(gain.argmax()), bins)
                best = max(best, (float(gain[f, b]), f, b))
            if best[1] < 0:
                margin[rows] += nodes[node][4]
                continue
            _, f, b = best
            goes = binned[rows, f] <= b
            nodes[node][:4] = [f, edges[f][b], len(nodes), len(nodes) + 1]
            for part in (rows[goes], rows[~goes]):
                nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
                todo.append((len(nodes) - 1, part, level + 1))
    columns = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    return Trees(np.array(roots, np.int32), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), base, depth)


@dataclass
class Isotonic:
    """A rising map of scores, fitted by pooling adjacent violators; straight between its blocks' centres."""

    at: np.ndarray
    to: np.ndarray
    #: Part of the raw score in the result, so that rows within a flat block keep their order.
    raw: float = 0.01

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return scores
        return np.clip((1 - self.raw) * np.interp(scores, self.at, self.to) + self.raw * scores, 0, 1)


def isotonic(scores: np.ndarray, y: np.ndarray) -> Isotonic:
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
