"""Gradient-boosted trees on a bounded matrix: histogram splits, monotonic constraints, flat node arrays, calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class FlatTrees:
    """All trees of a model in five node arrays; a leaf points at itself, so scoring is ``depth`` array look-ups a tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


@dataclass(frozen=True, eq=False)
class Boosting:
    """Parameters of the fit.  ``monotone`` maps a feature to +1 or -1: the score may only rise or fall with it."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    l2: float = 1.0
    min_rows: int = 3
    monotone: dict[int, int] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> FlatTrees:
        """Newton boosting of the log-loss.  Without rows or with one class only, a model that is constant."""
        n, width = x.shape
        share = (y.sum() + 0.5) / (n + 1.0)
        base = float(np.log(share / (1 - share)))
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
        roots: list[int] = []
        if n and 0 < y.sum() < n:
            edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
            binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
            raw = np.full(n, base)
            for _ in range(self.trees):
                p = 1.0 / (1.0 + np.exp(-raw))
                roots.append(self._grow(nodes, binned, edges, p - y, np.maximum(p * (1 - p), 1e-12), np.arange(n), 0,
                                        (-np.inf, np.inf), raw))
        arrays = {k: np.array(v, dtype=float if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
        return FlatTrees(**arrays, roots=np.array(roots, dtype=np.int64), depth=self.depth, base=base)

    def _grow(self, nodes, binned, edges, grad, hess, rows, level, bounds, raw) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes["value"])
        value = float(np.clip(-g / (h + self.l2), *bounds))
        for key, start in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", self.rate * value)):
            nodes[key].append(start)
        best = self._best_split(binned, edges, grad, hess, rows, g, h, bounds) if level < self.depth else None
        if best is None:
            raw[rows] += self.rate * value
            return at
        _, j, cut, (lower, upper) = best
        goes_left = binned[rows, j] <= cut
        sign, middle = self.monotone.get(j, 0), (lower + upper) / 2
        left_bounds = right_bounds = bounds
        if sign > 0:
            left_bounds, right_bounds = (bounds[0], middle), (middle, bounds[1])
        elif sign < 0:
            left_bounds, right_bounds = (middle, bounds[1]), (bounds[0], middle)
        nodes["feature"][at], nodes["threshold"][at] = j, float(edges[j][cut])
        nodes["left"][at] = self._grow(nodes, binned, edges, grad, hess, rows[goes_left], level + 1, left_bounds, raw)
        nodes["right"][at] = self._grow(nodes, binned, edges, grad, hess, rows[~goes_left], level + 1, right_bounds, raw)
        return at

    def _best_split(self, binned, edges, grad, hess, rows, g, h, bounds):
        best = None
        for j, edge in enumerate(edges):
            if not len(edge):
                continue
            bins = binned[rows, j]
            size = len(edge) + 1
            gl = np.cumsum(np.bincount(bins, grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(bins, hess[rows], size))[:-1]
            nl = np.cumsum(np.bincount(bins, minlength=size))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = (np.clip(-a / (b + self.l2), *bounds) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + 0.5 * (hl + self.l2) * vl**2) - (gr * vr + 0.5 * (hr + self.l2) * vr**2)
            allowed = (nl >= self.min_rows) & (len(rows) - nl >= self.min_rows)
            if sign := self.monotone.get(j, 0):
                allowed &= sign * (vr - vl) >= 0
            gain = np.where(allowed, gain, -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > (best[0] if best else 0.5 * g * g / (h + self.l2) + 1e-9):
                best = (gain[cut], j, cut, (vl[cut], vr[cut]))
        return best


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step values of ``y`` over ``score`` (adjacent blocks pooled), as points to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest and highest score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == s:
            b = blocks[-1]
            b[0], b[1] = (b[0] * b[1] + v) / (b[1] + 1), b[1] + 1
        else:
            blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, high = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, high
    points = sorted({(s, b[0]) for b in blocks for s in (b[2], b[3])})
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def out_of_fold(boosting: Boosting, x: np.ndarray, y: np.ndarray, folds: int) -> np.ndarray:
    """Log-odds of each row from a model that has not seen it."""
    raw = np.zeros(len(y))
    for k in range(folds):
        held = np.arange(len(y)) % folds == k
        raw[held] = boosting.fit(x[~held], y[~held]).raw(x[held])
    return raw
