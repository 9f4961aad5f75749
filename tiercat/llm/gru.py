"""Gated recurrent language model in numpy with a class-factored output.

A token is a model word or a rare class (a stand-in for all rarer words of one kind). The output
is p(class | state) and, for a model word, p(word | class, state). Training runs lanes of
concatenated documents in windows of ``STEPS`` tokens: gradients stop at the window's start
(truncated backpropagation), the state is carried on, and a document's first token starts from
a zero state. Scoring carries the state over a whole document of any length.
"""

from __future__ import annotations

import numpy as np

STEPS = 16
F4 = np.float32


class Layout:
    """Words 0..words-1 in order of frequency, cut into classes; then ``rare`` rare classes, each a
    class of its own; the last input row starts a document."""

    def __init__(self, class_of: np.ndarray, rare: int, hidden: int):
        self.words, self.rare, self.hidden = len(class_of), rare, hidden
        self.word_classes = int(class_of.max()) + 1 if len(class_of) else 0
        self.classes = self.word_classes + rare
        self.class_of = np.concatenate([class_of, self.word_classes + np.arange(rare)]).astype(np.int64)
        # words of one class are neighbours
        self.first = np.searchsorted(class_of, np.arange(self.word_classes + 1))
        h = hidden
        self.shapes = {"x": (self.words + rare + 1, 3 * h), "u": (h, 3 * h), "c": (h, self.classes),
                       "cb": (self.classes,), "w": (self.words, h), "wb": (self.words,)}

    @property
    def start(self) -> int:
        return self.words + self.rare

    def initial(self, counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
        """Random weights; output biases say the frequencies ``counts`` (words, then rare)."""
        rng = np.random.default_rng(seed)
        p = {k: (rng.standard_normal(s) * (0.1 if k in "xw" else 0.25)).astype(F4) for k, s in self.shapes.items()}
        p["wb"] = np.log(counts[:self.words] + 0.5).astype(F4)
        total = np.bincount(self.class_of, counts + 0.5, self.classes)
        p["cb"] = np.log(total / total.sum()).astype(F4)
        p["x"][:, :self.hidden] += 1.0  # gates begin by keeping the state
        return p

    def flat(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in self.shapes])

    def unflat(self, v: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = v[at:at + n].reshape(s).astype(F4)
            at += n
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: dict[str, np.ndarray], h: np.ndarray, tokens: np.ndarray):
    """(new state, gate, reset, candidate, recurrent part of the candidate)."""
    n = h.shape[1]
    a = p["x"][tokens]
    u = h @ p["u"]
    zr = _sigmoid(a[:, :2 * n] + u[:, :2 * n])
    z, r = zr[:, :n], zr[:, n:]
    un = u[:, 2 * n:]
    c = np.tanh(a[:, 2 * n:] + r * un)
    return c + z * (h - c), z, r, c, un


def _masses(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits, in place, and its row sums. Logits are held in a range where single
    precision neither overflows nor loses a row."""
    if x.max(initial=0) > 60 or x.min(initial=0) < -60:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], F4)


def _picked(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the target of every row of logits."""
    at = np.clip(x[np.arange(len(x)), target], -60, 60)
    return at - np.log(_masses(x)[1])


def word_groups(layout: Layout, targets: np.ndarray):
    """(rows, class, first word, end word) for every class of model words among the targets."""
    order = np.argsort(layout.class_of[targets], kind="stable")
    classes = layout.class_of[targets[order]]
    cuts = np.searchsorted(classes, np.arange(layout.word_classes + 1))
    for c in range(layout.word_classes):
        if cuts[c + 1] > cuts[c]:
            yield order[cuts[c]:cuts[c + 1]], c, layout.first[c], layout.first[c + 1]


def log_p(layout: Layout, p: dict[str, np.ndarray], h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target (of a rare class: of the class) after its state."""
    x = h @ p["c"]
    x += p["cb"]
    out = _picked(x, layout.class_of[targets])
    for rows, _, a, b in word_groups(layout, targets):
        if b - a > 1:
            x = h[rows] @ p["w"][a:b].T
            x += p["wb"][a:b]
            out[rows] += _picked(x, targets[rows] - a)
    return out


def score(layout: Layout, p: dict[str, np.ndarray], docs: list[np.ndarray], lanes: int = 512) -> np.ndarray:
    """Natural log probability of every document (ids). Documents of similar length go side by
    side, each with its own state from its first to its last token."""
    out = np.zeros(len(docs))
    sizes = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    for g in range(0, len(docs), lanes):
        group = order[g:g + lanes]
        n = sizes[group]
        h = np.zeros((len(group), layout.hidden), F4)
        last = np.full(len(group), layout.start, np.int64)
        for t0 in range(0, int(n[0]) if len(n) else 0, STEPS):
            width = int(np.searchsorted(-n, -t0, side="left"))  # documents longer than t0
            ids = np.zeros((width, STEPS), np.int64)
            for i, d in enumerate(group[:width]):
                part = docs[d][t0:t0 + STEPS]
                ids[i, :len(part)] = part
            states, targets, owners = [], [], []
            for t in range(STEPS):
                live = int(np.searchsorted(-n, -(t0 + t), side="left"))
                if not live:
                    break
                h[:live] = step(p, h[:live], last[:live])[0]
                last[:live] = ids[:live, t]
                states.append(h[:live].copy())
                targets.append(ids[:live, t])
                owners.append(np.arange(live))
            lp = log_p(layout, p, np.concatenate(states), np.concatenate(targets))
            out[group] += np.bincount(np.concatenate(owners), lp, len(group))
    return out


class Trainer:
    """Adagrad on windows of lanes."""

    def __init__(self, layout: Layout, p: dict[str, np.ndarray], rate: float = 0.1):
        self.layout, self.p, self.rate = layout, {k: v.copy() for k, v in p.items()}, rate
        self.seen = {k: np.full(s, 1e-2, F4) for k, s in layout.shapes.items()}

    def _apply(self, k: str, g: np.ndarray, rows=slice(None)) -> None:
        np.clip(g, -1, 1, out=g)
        s = self.seen[k][rows] + g * g
        self.seen[k][rows] = s
        self.p[k][rows] -= self.rate * g / np.sqrt(s)

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray,
               use: np.ndarray) -> np.ndarray:
        """One update. inputs, targets, fresh (a document starts), use (a real token): (steps, lanes).
        Returns the state behind the window."""
        lay, p, n = self.layout, self.p, self.layout.hidden
        steps, lanes = inputs.shape
        before, kept = [], []
        for t in range(steps):
            h = np.where(fresh[t][:, None], F4(0), h)
            before.append(h)
            h, *parts = step(p, h, inputs[t])
            kept.append((h, *parts))
        hs = np.concatenate([k[0] for k in kept])
        tg, weight = targets.ravel(), use.ravel().astype(F4) / lanes
        at = np.arange(len(tg))
        d = hs @ p["c"]
        d += p["cb"]
        d, mass = _masses(d)
        d *= (weight / mass)[:, None]
        d[at, lay.class_of[tg]] -= weight
        g = {"c": hs.T @ d, "cb": d.sum(axis=0)}
        dh_out = d @ p["c"].T
        gw, gwb = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        for rows, _, a, b in word_groups(lay, tg):
            if b - a < 2:
                continue
            hr = hs[rows]
            e = hr @ p["w"][a:b].T
            e += p["wb"][a:b]
            e, mass = _masses(e)
            e *= (weight[rows] / mass)[:, None]
            e[np.arange(len(rows)), tg[rows] - a] -= weight[rows]
            gw[a:b], gwb[a:b] = e.T @ hr, e.sum(axis=0)
            dh_out[rows] += e @ p["w"][a:b]
        gu = np.zeros_like(p["u"])
        ga = np.empty((steps, lanes, 3 * n), F4)
        dh = np.zeros((lanes, n), F4)
        dh_out = dh_out.reshape(steps, lanes, n)
        for t in range(steps - 1, -1, -1):
            dh = dh + dh_out[t]
            _, z, r, c, un = kept[t]
            h0 = before[t]
            dc = dh * (1 - z) * (1 - c * c)
            du = np.concatenate([dh * (h0 - c) * z * (1 - z), dc * un * r * (1 - r), dc * r], axis=1)
            ga[t, :, :2 * n], ga[t, :, 2 * n:] = du[:, :2 * n], dc
            gu += h0.T @ du
            dh = dh * z + du @ p["u"].T
            dh[fresh[t]] = 0
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        self._apply("x", np.add.reduceat(ga.reshape(-1, 3 * n)[order], first, axis=0), rows)
        self._apply("u", gu)
        self._apply("c", g["c"])
        self._apply("cb", g["cb"])
        self._apply("w", gw)
        self._apply("wb", gwb)
        return h

    def train(self, docs: list[np.ndarray], lanes: int = 512, least: int = 64) -> int:
        """One pass over documents (ids); returns the tokens seen. Documents are laid end to end
        and the line is cut into lanes of equal length; what a cut divides goes on from a
        zero state."""
        docs = [d for d in docs if len(d)]
        total = int(sum(len(d) for d in docs))
        if not total:
            return 0
        lanes = int(min(lanes, max(8, total // (STEPS * least))))
        line = np.concatenate(docs).astype(np.int64)
        starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
        fresh = np.zeros(total, bool)
        fresh[starts] = True
        inputs = np.concatenate([[self.layout.start], line[:-1]])
        inputs[fresh] = self.layout.start
        long = -(-total // lanes)
        long = -(-long // STEPS) * STEPS
        pad = lanes * long - total
        use = np.ones(total, bool)
        inputs, line, fresh, use = (np.concatenate([x, np.zeros(pad, x.dtype)]).reshape(lanes, long).T
                                    for x in (inputs, line, fresh, use))
        h = np.zeros((lanes, self.layout.hidden), F4)
        for t in range(0, long, STEPS):
            s = slice(t, t + STEPS)
            h = self.window(h, inputs[s], line[s], fresh[s], use[s])
        return total


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of every word (in order of frequency), each class with a like share of the sum of
    square roots of frequencies."""
    if not len(counts):
        return np.zeros(0, np.int64)
    share = np.cumsum(np.sqrt(counts))
    c = np.minimum((share / share[-1] * classes).astype(np.int64), classes - 1)
    return np.unique(c, return_inverse=True)[1]
