"""Generalised additive model with pairwise interactions for binary labels, in numpy.

Cyclic boosting: every round visits the features in turn, fits one shallow regression tree
to the current gradients of that feature's bins, and adds its shrunken leaf values to the
feature's lookup table. Then the strongest pairs, ranked by the best 2 x 2 cut of the
residuals, get two-dimensional tables in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Gam:
    cuts: list[np.ndarray]                    # per feature: ascending bin edges
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # per feature: bin -> pair bin
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[b[f]]
        for f, g, table in self.pairs:
            out += table[self.coarse[f][b[f]], self.coarse[g][b[g]]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def edges(x: np.ndarray, n_bins: int) -> np.ndarray:
    """Edges between quantiles of the distinct values, at most ``n_bins - 1``."""
    q = np.quantile(x, np.linspace(0, 1, n_bins + 1)[1:-1])
    values = np.unique(x)
    at = np.unique(np.searchsorted(values, q))
    at = at[(at > 0) & (at < len(values))]
    return (values[at - 1] + values[at]) / 2


def _gain(g, h, lam):
    return g * g / (h + lam)


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Leaf values, spread over bins, of the tree that best-first splits a line of bins."""
    n = len(g)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a, b):
        if b - a < 2:
            return 0.0, a
        gl, hl = cg[a + 1:b] - cg[a], ch[a + 1:b] - ch[a]
        gt, ht = cg[b] - cg[a], ch[b] - ch[a]
        gain = _gain(gl, hl, lam) + _gain(gt - gl, ht - hl, lam) - _gain(gt, ht, lam)
        k = int(np.argmax(gain))
        return float(gain[k]), a + 1 + k

    parts = [(0, n)]
    while len(parts) < leaves:
        found = [(best(a, b), i) for i, (a, b) in enumerate(parts)]
        (gain, cut), i = max(found)
        if gain <= 1e-12:
            break
        a, b = parts.pop(i)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def cross_cut(g: np.ndarray, h: np.ndarray, lam: float):
    """The best 2 x 2 cut of a grid: (gain, row cut, column cut, quadrant values)."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = np.zeros_like(cg)
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quads(c):
        a = c[1:-1, 1:-1]
        b = c[1:-1, -1:] - a
        d = c[-1:, 1:-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    qg, qh = quads(cg), quads(ch)
    if not qg[0].size:
        return 0.0, 0, 0, (0.0,) * 4
    gain = sum(_gain(x, y, lam) for x, y in zip(qg, qh)) - _gain(cg[-1, -1], ch[-1, -1], lam)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = tuple(float(x[r, c] / (y[r, c] + lam)) for x, y in zip(qg, qh))
    return float(gain[r, c]), int(r) + 1, int(c) + 1, values


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 120, pair_rounds: int = 40,
        n_pairs: int = 8, leaves: int = 3, rate: float = 0.15, lam: float = 4.0,
        pair_bins: int = 12) -> Gam:
    """Train on features ``x`` (rows, features) and labels ``y`` (0/1). Without rows the model
    says 0.5; with one class it says that class, shrunk."""
    n = len(y)
    model = Gam([edges(x[:, f], n_bins) if n else np.zeros(0) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.coarse = [np.minimum((np.arange(len(c) + 1) * pair_bins) // max(len(c) + 1, pair_bins),
                               pair_bins - 1) if len(c) + 1 > pair_bins else np.arange(len(c) + 1)
                    for c in model.cuts]
    prior = (float(np.sum(y)) + 0.5) / (n + 1.0)
    model.intercept = float(np.log(prior / (1 - prior)))
    if not n:
        return model
    b = model.bins(x)
    margin = np.full(n, model.intercept)

    def gradients():
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * tree_1d(np.bincount(b[f], g, len(table)), np.bincount(b[f], h, len(table)),
                                  leaves, lam)
            table += step
            margin += step[b[f]]
    c = [model.coarse[f][b[f]] for f in range(x.shape[1])]
    size = [int(m.max()) + 1 for m in model.coarse]

    def grid(f, g_, v):
        return np.bincount(c[f] * size[g_] + c[g_], v, size[f] * size[g_]).reshape(size[f], size[g_])

    g, h = gradients()
    ranked = sorted(((cross_cut(grid(i, j, g), grid(i, j, h), lam)[0], i, j)
                     for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for gain, i, j in ranked if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = gradients()
            _, r, k, (v1, v2, v3, v4) = cross_cut(grid(i, j, g), grid(i, j, h), lam)
            step = np.zeros_like(table)
            step[:r, :k], step[:r, k:], step[r:, :k], step[r:, k:] = v1, v2, v3, v4
            step *= rate
            table += step
            margin += step[c[i], c[j]]
    # centred tables: the intercept holds the mean, a table the deviation
    for f, table in enumerate(model.tables):
        mean = float(table[b[f]].mean())
        table -= mean
        model.intercept += mean
    return model
