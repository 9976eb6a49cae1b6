"""Gradient-boosted trees for two classes, on binned features, with calibrated thresholds. Small enough to train on the driver in a second."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic loss, Newton leaves, depth-limited trees grown on histograms."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0, penalty: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.least, self.penalty = trees, depth, rate, least, penalty
        self.cuts: list[np.ndarray] = []
        self.base = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.threshold = 0.5
        self.scale, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = []
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            self.cuts.append((v[1:] + v[:-1]) / 2 if len(v) <= BINS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])))
        b, width = self._binned(x), BINS + 1
        flat = b + np.arange(x.shape[1]) * width
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        n_nodes = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes)
            value = np.zeros(2 ** (self.depth + 1) - 1)
            at = np.zeros(len(y), np.int64)
            for node in range(n_nodes):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * self.least:
                    continue
                size = x.shape[1] * width
                g = np.bincount(
                    flat[rows].ravel(),
                    weights=np.repeat(grad[rows], x.shape[1]),
                    minlength=size,
                ).reshape(-1, width).cumsum(axis=1)
                h = np.bincount(
                    flat[rows].ravel(),
                    weights=np.repeat(hess[rows], x.shape[1]),
                    minlength=size,
                ).reshape(-1, width).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                best = int(np.argmax(gain))
                f, c = divmod(best, width)
                if gain.ravel()[best] < 1e-3 or c >= len(self.cuts[f]):
                    continue
                feature[node], cut[node] = f, self.cuts[f][c]
                left = b[rows, f] <= c
                at[rows] = np.where(left, 2 * node + 1, 2 * node + 2)
            for node in np.unique(at):
                rows = at == node
                value[node] = self.rate * grad[rows].sum() / (hess[rows].sum() + self.penalty)
            score += value[at]
            self.nodes.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = at < len(feature)
                f = np.where(inner, feature[np.minimum(at, len(feature) - 1)], -1)
                go = f >= 0
                if not go.any():
                    break
                right = x[every, np.maximum(f, 0)] > cut[np.minimum(at, len(feature) - 1)]
                at = np.where(go, 2 * at + 1 + right, at)
            out += value[at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """Logistic scaling on held-out rows; the threshold is the lowest with at least ``precision`` there (or the best F1 if none has)."""
        s = self.raw(x)
        a, c = 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y <= 0).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            w, e = np.maximum(p * (1 - p), 1e-9), p - t
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, np.array([(e * s).sum(), e.sum()]))
            a, c = a - step[0], c - step[1]
            if abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(c)
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        prec = hits / np.arange(1, len(y) + 1)
        good = np.flatnonzero(prec >= precision)
        at = int(good[-1]) if len(good) else int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))))
        after = p[order[at + 1]] if at + 1 < len(y) else 0.0
        self.threshold = float(min(0.9, max(0.1, (p[order[at]] + after) / 2)))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))
