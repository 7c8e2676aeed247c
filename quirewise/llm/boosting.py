"""Gradient-boosted trees for small numeric features, with Platt calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting; a tree is a list of (feature, cut, left, right) or (None, value)."""

    def __init__(self, trees: list, base: float, rate: float, slope: float = 1.0, shift: float = 0.0):
        self.trees, self.base, self.rate, self.slope, self.shift = trees, base, rate, slope, shift

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.2, least: float = 1.0) -> Boosted:
        base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        model, f = cls([], base, rate), np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree: list = []
            _grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), depth, least)
            model.trees.append(tree)
            f += rate * _values(tree, x)
        return model

    def margins(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * _values(tree, x)
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Fits slope and shift on other rows, by Newton steps with a weak prior."""
        f = self.margins(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * f).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
            h = np.array([[(w * f * f).sum() + 0.1, (w * f).sum()], [(w * f).sum(), w.sum() + 0.1]])
            move = np.linalg.solve(h, g)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-8:
                break
        self.slope, self.shift = a, b
        return self

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.shift, -30, 30)))


def _grow(tree: list, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: float) -> int:
    """Appends the subtree over `rows`; its place in the list."""
    at = len(tree)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    tree.append((None, float(total_g / (total_h + least))))
    best = (1e-6, None, None)
    if depth:
        for k in range(x.shape[1]):
            v = x[rows, k]
            order = np.argsort(v, kind="stable")
            ends = np.flatnonzero(v[order][1:] > v[order][:-1])
            if not len(ends):
                continue
            gl, hl = np.cumsum(g[rows][order])[ends], np.cumsum(h[rows][order])[ends]
            gain = gl**2 / (hl + least) + (total_g - gl) ** 2 / (total_h - hl + least) - total_g**2 / (total_h + least)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, float(v[order][ends[i]] + v[order][ends[i] + 1]) / 2)
    if best[1] is not None:
        left = x[rows, best[1]] <= best[2]
        tree[at] = (best[1], best[2], _grow(tree, x, g, h, rows[left], depth - 1, least), _grow(tree, x, g, h, rows[~left], depth - 1, least))
    return at


def _values(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if tree[at][0] is None:
            out[rows] = tree[at][1]
        else:
            k, cut, left, right = tree[at]
            low = x[rows, k] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
    return out
