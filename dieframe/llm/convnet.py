"""A one-layer convolutional classifier in numpy: embeddings, filters of several widths, max pooling, logistic output.

Items are sequences of feature hashes of any length, laid end to end; none is cut or padded to a length.
"""

from __future__ import annotations

import numpy as np

from .common import runs


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    """x moved up by k rows, with zeros after its end."""
    if not k:
        return x
    out = np.zeros_like(x)
    out[:-k] = x[k:]
    return out


LOW = np.float32(-1e9)  # of a window that doesn't count


class ConvNet:
    """vocabulary: sorted feature hashes that have an embedding; any other feature counts as nothing.

    A position may have several features (columns of the hash array); their embeddings are added. Only windows
    that lie wholly in their item count. With `gaps`, a position whose first feature is row 0 parts its item:
    no window reaches over it.
    """

    def __init__(self, vocabulary: np.ndarray, size: int = 12, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, seed: int = 7, gaps: bool = False):
        r = np.random.default_rng(seed)
        self.gaps = gaps
        self.vocabulary = vocabulary
        self.widths, self.filters = widths, filters
        self.emb = r.normal(0, 0.1, (len(vocabulary) + 1, size)).astype(np.float32)
        self.emb[0] = 0
        self.taps = [r.normal(0, 1 / np.sqrt(w * size), (w, size, filters)).astype(np.float32) for w in widths]
        self.bias = np.zeros((len(widths), filters), np.float32)
        self.out = r.normal(0, 0.3, len(widths) * filters).astype(np.float32)
        self.base = np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows of hashes; 0 for those without one."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(hashes.shape, int)

    def _activations(self, e: np.ndarray, rows: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
        """Per width: the activations (n, filters) of the windows that begin at each position, before pooling."""
        at = np.arange(len(e))
        left = np.repeat(edge[1:], np.diff(edge)) - at  # positions up to the end of the item
        if self.gaps:
            gap = np.where(rows[:, 0] == 0, at, len(e))
            left = np.minimum(left, np.minimum.accumulate(gap[::-1])[::-1] - at)
        out = []
        for w, tap, b in zip(self.widths, self.taps, self.bias):
            h = e @ tap[0] + b
            for k in range(1, w):
                h += _shifted(e @ tap[k], k)
            h[left < w] = LOW
            out.append(h)
        return out

    def logits(self, rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """edge: starts of the items and the end; every item has one position at least."""
        e = self.emb[rows].sum(1)
        pooled = np.concatenate([np.maximum.reduceat(h, edge[:-1], axis=0) for h in self._activations(e, rows, edge)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.base

    def score(self, rows: np.ndarray, edge: np.ndarray) -> np.ndarray:
        z = self.scale * self.logits(rows, edge).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def step(self, rows: np.ndarray, edge: np.ndarray, label: np.ndarray, rate: float, state: dict, decay: float) -> None:
        """One Adagrad step; the gradient of max pooling touches one window an item and filter."""
        e = self.emb[rows].sum(1)
        hidden = self._activations(e, rows, edge)
        m = len(edge) - 1
        first = []
        for h in hidden:
            top = np.maximum.reduceat(h, edge[:-1], axis=0)
            hit = h == np.repeat(top, np.diff(edge), axis=0)
            first.append((top, np.minimum.reduceat(np.where(hit, np.arange(len(h))[:, None], len(h)), edge[:-1], axis=0)))
        act = np.maximum(np.concatenate([t for t, _ in first], axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.base, -30, 30)))
        d = ((p - label) / m).astype(np.float32)

        def move(name, value, grad):
            state[name] = state.get(name, 1e-6) + grad * grad
            value -= rate * grad / np.sqrt(state[name])

        back = d[:, None] * self.out[None, :] * (act > 0)
        move("out", self.out, act.T @ d + decay * self.out)
        self.base -= np.float32(rate * d.sum())
        changes: list[tuple[np.ndarray, np.ndarray]] = []
        for i, (w, tap) in enumerate(zip(self.widths, self.taps)):
            g = back[:, i * self.filters : (i + 1) * self.filters]
            at = first[i][1]
            grad = np.zeros_like(tap)
            for k in range(w):
                pos = at + k
                ok = pos < edge[1:][:, None]
                pos = np.where(ok, pos, 0)
                gk = g * ok
                grad[k] = np.einsum("bfe,bf->ef", e[pos], gk)
                if k < w:
                    changes.append((rows[pos].reshape(-1, rows.shape[1]), (gk[:, :, None] * tap[k].T[None]).reshape(-1, tap.shape[1])))
            move(f"bias{i}", self.bias[i], g.sum(0))
            move(f"tap{i}", tap, grad + decay * tap)
        which = np.concatenate([c.T.ravel() for c, _ in changes])
        much = np.concatenate([np.tile(v, (rows.shape[1], 1)) for _, v in changes])
        used, where = np.unique(which, return_inverse=True)
        order = np.argsort(where, kind="stable")
        grad = np.add.reduceat(much[order], runs(where[order]), axis=0) + decay * self.emb[used]
        kept = state.setdefault("emb", np.full(self.emb.shape, 1e-6, np.float32))
        kept[used] += grad * grad
        self.emb[used] -= rate * grad / np.sqrt(kept[used])
        self.emb[0] = 0

    def fit(self, rows: list[np.ndarray], label: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        state: dict = {}
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                edge = np.append(0, np.cumsum([len(rows[i]) for i in part]))
                self.step(np.concatenate([rows[i] for i in part]), edge, label[part].astype(np.float32), rate, state, decay)

    def calibrate(self, logits: np.ndarray, label: np.ndarray, many: np.ndarray | float = 1.0, weight: np.ndarray | float = 1.0) -> None:
        """Platt scaling: the probability as a logistic function of the logit, by Newton's method with smoothed targets.

        Each logit stands for `many` rows of `weight` each. Targets are smoothed by the rows, whatever they weigh.
        """
        n1, n0 = (label * many).sum(), ((1 - label) * many).sum()
        if not n1 or not n0:
            return
        t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
        each = np.broadcast_to(many * weight, label.shape)

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((each * (np.logaddexp(0, z) - t * z)).sum() + 5e-5 * ((w - [1, 0]) ** 2).sum())

        w = np.array([0.0, np.log((each * t).sum() / (each * (1 - t)).sum())])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = (x * (each * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-4 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (each * (p - t)) + 1e-4 * (w - [1, 0]))
            before, part = loss(w), 1.0
            while loss(w - part * step) > before and part > 1e-6:  # far off, a whole step may lead away
                part /= 2
            w = w - part * step
            if np.abs(part * step).max() < 1e-9:
                break
        # logits that don't rise with the label say nothing: then all get the share of label 1
        self.scale, self.shift = (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((each * label).sum() / (each * (1 - label)).sum())))


def frequent(features: list[np.ndarray], least: int) -> np.ndarray:
    """Sorted hashes that stand in `least` items or more."""
    each = np.concatenate([np.unique(x) for x in features]) if features else np.empty(0, np.uint64)
    found, many = np.unique(each, return_counts=True)
    return found[many >= least]
