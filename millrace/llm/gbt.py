"""Gradient-boosted trees for two classes on histograms of features; small training sets, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree in arrays: at inner node i rows with x[feature] <= threshold go to 2i + 1, others to 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        inner = len(self.feature)
        rows = np.arange(len(x))
        while (go := at < inner).any():
            f = self.feature[np.minimum(at, inner - 1)]
            right = x[rows, f] > self.threshold[np.minimum(at, inner - 1)]
            at = np.where(go, 2 * at + 1 + right, at)
        return self.value[at - inner]


@dataclass
class Boosted:
    """Logistic boosting with second-order leaf values. Each tree sees a random half of the features, so that no
    single statistic decides alone; the seed makes fits repeatable."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    feature_share: float = 0.5
    l2: float = 5.0
    seed: int = 11
    base: float = 0.0
    fitted: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        rng = np.random.default_rng(self.seed)
        n, d = x.shape
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.fitted = float(np.log(p / (1 - p))), []
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        cell = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(n, self.base)
        inner = 2 ** self.depth - 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            features = rng.permutation(d)[: max(1, int(d * self.feature_share))]
            tree = Tree(np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1))
            at = np.zeros(n, dtype=np.int64)
            for node in range(inner):
                own = np.flatnonzero(at == node)
                if len(own) == 0:
                    continue
                best = (1e-6, 0, np.inf)
                tg, th = g[own].sum(), h[own].sum()
                for j in features:
                    k = len(edges[j])
                    if k == 0:
                        continue
                    lg = np.cumsum(np.bincount(cell[own, j], g[own], k + 1))[:-1]
                    lh = np.cumsum(np.bincount(cell[own, j], h[own], k + 1))[:-1]
                    gain = lg**2 / (lh + self.l2) + (tg - lg) ** 2 / (th - lh + self.l2) - tg**2 / (th + self.l2)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], j, edges[j][b])
                tree.feature[node], tree.threshold[node] = best[1], best[2]
                at[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
            leaves = at - inner
            lg, lh = np.bincount(leaves, g, inner + 1), np.bincount(leaves, h, inner + 1)
            tree.value = self.rate * lg / (lh + self.l2)
            score = score + tree.value[leaves]
            self.fitted.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.base)
        for t in self.fitted:
            out += t.leaf(x)
        return out


def platt(score: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * score + b))) is calibrated; targets are smoothed by the class sizes."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - t * z).sum() + l2 / 2 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - t) * score).sum() + l2 * (a - 1), (p - t).sum()
        haa, hab, hbb = (w * score**2).sum() + l2, (w * score).sum(), w.sum() + 1e-6
        det = haa * hbb - hab**2
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a + step * da, b + step * db) > now:  # separable classes overshoot otherwise
            step /= 2
        if step <= 1e-6 or abs(step * da) + abs(step * db) < 1e-9:
            break
        a, b = a + step * da, b + step * db
    return float(max(a, 1e-2)), float(b)
