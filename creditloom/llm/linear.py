"""Linear models on sparse rows, fitted by L-BFGS on a bounded sample inside one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: row i has features index[start[i] : start[i + 1]] with the given values; every row has one."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray], width: int):
        self.count = np.array([len(x) for x in index], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.index = np.concatenate(index) if index else np.empty(0, np.int32)
        self.value = np.concatenate(value).astype(np.float64) if value else np.empty(0)
        self.width = width

    def keep(self, wanted: np.ndarray) -> None:
        """Zero the values of all other features."""
        self.value = self.value * wanted[self.index]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.index] * self.value, self.start) if len(self.start) else np.empty(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * np.repeat(g, self.count), self.width)


def squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.maximum(0.0, 1.0 - margin)
    return gap * gap, -2.0 * gap


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.logaddexp(0.0, -margin), -sigmoid(-margin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, y: np.ndarray, loss: Callable, penalty: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept for labels y of -1 and 1; ``penalty`` times half the squared weights is added."""

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        each, slope = loss(y * (rows.times(w) + b))
        g = slope * y
        return float(each.sum() + 0.5 * penalty * (w @ w)), np.append(rows.back(g) + penalty * w, g.sum())

    x = np.zeros(rows.width + 1)
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        # two-loop recursion over the last ten steps
        d, factors = g.copy(), []
        for s, t, r in reversed(pairs):
            factors.append(r * (s @ d))
            d -= factors[-1] * t
        if pairs:
            s, t, _ = pairs[-1]
            d *= (s @ t) / (t @ t)
        for (s, t, r), a in zip(pairs, reversed(factors)):
            d += (a - r * (t @ d)) * s
        step, slope = (1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(g)))), float(g @ d)
        while step > 1e-10:
            trial = x - step * d
            ft, gt = value(trial)
            if ft <= f - 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, t = trial - x, gt - g
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t, 1.0 / (s @ t))]
        done = f - ft <= 1e-6 * max(1.0, abs(f))
        x, f, g = trial, ft, gt
        if done:
            break
    return x[:-1], float(x[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * margin + b) is the probability of y = 1, by Newton's method on smoothed labels."""
    up = (y > 0).sum()
    t = np.where(y > 0, (up + 1.0) / (up + 2.0), 1.0 / (len(y) - up + 2.0))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        r, w = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(r * margin).sum() + 1e-6 * (a - 1), r.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 0.0)), float(b)
