"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes in flat arrays: feature (-1: a leaf), threshold (left if <=), children, value; roots: where trees begin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[at]
            go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, go)
        return out + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting. monotone: feature to +1 (the score may only rise with it) or -1. No rows: a constant of 0."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    rate_y = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(rate_y / (1 - rate_y)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin = np.full(len(y), base)

    def weight(g: float, h: float) -> float:
        return -g / (h + l2)

    def grow(rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, 0, float(np.clip(weight(G, H), lo, hi)) * rate])
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, -1, 0)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            left, right = np.clip(-gs / (hs + l2), lo, hi), np.clip(-(G - gs) / (H - hs + l2), lo, hi)
            gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
            ok = (ns >= least) & (len(rows) - ns >= least)
            if j in monotone:
                ok &= (right - left) * monotone[j] >= 0
            gain = np.where(ok, gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] < 0:
            return me
        _, j, k = best
        side = binned[rows, j] <= k
        a, b = rows[side], rows[~side]
        mid = (np.clip(weight(g[a].sum(), h[a].sum()), lo, hi) + np.clip(weight(g[b].sum(), h[b].sum()), lo, hi)) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}.get(monotone.get(j, 0), ((lo, hi), (lo, hi)))
        nodes[me][:2] = [j, float(edges[j][k])]
        nodes[me][2] = grow(a, level + 1, *bounds[0], g, h)
        nodes[me][3] = grow(b, level + 1, *bounds[1], g, h)
        return me

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(nodes))
        grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-6))
        flat = np.array(nodes)
        one = Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots[-1:]), 0.0, depth)
        margin = margin + one.margin(x)
    flat = np.array(nodes).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), base, depth)
