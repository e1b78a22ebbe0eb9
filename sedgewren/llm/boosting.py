"""Gradient-boosted trees over a few numeric features, fitted on the driver on weighted rows; logistic loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on quantile bins, each fitted by Newton steps; probabilities are calibrated on rows kept apart."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, seed: int = 0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.seed = trees, depth, rate, bins, l2, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.offset = 0.0, 1.0, 0.0
        self.threshold = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = 0.97, weight: np.ndarray | None = None, apart: np.ndarray | None = None) -> BoostedTrees:
        """Rows count by ``weight`` (default 1); those of ``apart`` (default a fifth by chance) calibrate and set the threshold."""
        order = np.random.default_rng(self.seed).permutation(len(x))
        held, train = order[: len(order) // 5], order[len(order) // 5 :]
        if apart is not None:
            held, train = np.flatnonzero(apart), np.flatnonzero(~apart)
        w = np.ones(len(x)) if weight is None else weight
        edges = [np.unique(_quantiles(x[train, f], w[train], np.linspace(0, 1, self.bins)[1:-1]) if weight is not None else np.quantile(x[train, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[train, f], side="left") for f, e in enumerate(edges)], 1)
        target, p = y[train].astype(float), np.clip(np.average(y[train], weights=w[train]), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(train), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            feature, cut, leaf, at = self._grow(binned, edges, w[train] * (p - target), w[train] * np.maximum(p * (1 - p), 1e-6))
            self.nodes.append((feature, cut, leaf))
            score += leaf[at]
        self._calibrate(self.score(x[held]), y[held].astype(float), w[held])
        self.threshold = self._threshold(self.probability(x[held]), y[held], precision, weight=w[held])
        return self

    def _threshold(self, p: np.ndarray, y: np.ndarray, precision: float, low: float = 0.3, high: float = 0.9, weight: np.ndarray | None = None) -> float:
        """The lowest calibrated probability from which on the rows kept apart have the precision, between the bounds.

        It lies halfway to the next lower row; without rows kept apart, or if none reaches the precision, it is a bound.
        """
        order = np.argsort(-p, kind="stable")
        w = np.ones(len(y)) if weight is None else weight[order]
        right = np.cumsum(y[order] * w) / np.cumsum(w)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            return high if len(y) else 0.5
        last = p[order[good[-1]]]
        below = p[order[good[-1] + 1]] if good[-1] + 1 < len(p) else 0.0
        return float(np.clip((last + below) / 2, low, high))

    def _grow(self, binned, edges, g, h):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            for node in range(first, 2 * first + 1):
                mine = at == node
                best = 1e-9
                chosen = None
                if mine.any():
                    gm, hm, bm = g[mine], h[mine], binned[mine]
                    total_g, total_h = gm.sum(), hm.sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        gs = np.cumsum(np.bincount(bm[:, f], weights=gm, minlength=len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(bm[:, f], weights=hm, minlength=len(e) + 1))[:-1]
                        gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, chosen = gain[k], (f, k)
                if chosen:
                    feature[node], cut[node] = chosen[0], edges[chosen[0]][chosen[1]]
                    at[mine] = 2 * node + 1 + (binned[mine, chosen[0]] > chosen[1])
                else:
                    at[mine] = 2 * node + 1
        at -= inner
        leaves = 1 << self.depth
        leaf = -self.rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + self.l2)
        return feature, cut, leaf, at

    def score(self, x: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        for feature, cut, leaf in self.nodes:
            # from the leaves up: what each node gives every row
            given = list(leaf)
            for level in reversed(range(self.depth)):
                first = (1 << level) - 1
                for n in range(first + 1):
                    low, high = given[2 * n : 2 * n + 2]
                    given[n] = low if np.isinf(cut[first + n]) else np.where(columns[feature[first + n]] > cut[first + n], high, low)
            out += given[0]
        return out

    def _calibrate(self, s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt's sigmoid by Newton steps."""
        if weight.sum() < 20 or y.min() == y.max():
            return
        a, b = 1.0, 0.0
        for _ in range(30):
            p = np.clip(1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))), 1e-6, 1 - 1e-6)
            w, r = weight * p * (1 - p), weight * (p - y)
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(r * s).sum() + 1e-3 * (a - 1), r.sum()]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.offset = float(max(a, 0.05)), float(b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.offset, -30, 30)))


def _quantiles(x: np.ndarray, weight: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Values at which shares of the weight are reached."""
    order = np.argsort(x, kind="stable")
    reached = np.cumsum(weight[order])
    return x[order][np.minimum(np.searchsorted(reached, shares * reached[-1]), len(x) - 1)]
