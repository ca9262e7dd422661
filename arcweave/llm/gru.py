"""A gated recurrent unit over words in numpy, with a class-factored softmax.

The vocabulary is in order of frequency; classes are runs of equal length of it, so
a token's probability is that of its class times that of the token in the class.
Documents are dealt to lanes of a batch, one after another in each; windows of the
lanes are computed together, the state is carried from window to window and set
back where a document begins. Memory follows the tokens given and one window, not
the longest document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Tokens, tokens of a class, width of the state.
SIZE, PER_CLASS, HIDDEN = 512, 16, 16
CLASSES = SIZE // PER_CLASS
_SHAPES = {"e": (SIZE, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES, HIDDEN, PER_CLASS), "ob": (CLASSES, PER_CLASS)}
WEIGHTS = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 1, dtype: type = np.float32) -> np.ndarray:
    """Small random weights; the output biases are the logs of the tokens' frequencies."""
    flat = (np.random.default_rng(seed).standard_normal(WEIGHTS) * 0.08).astype(dtype)
    w, c = views(flat), (counts + 0.5).reshape(CLASSES, PER_CLASS)
    w["b"][:] = 0
    w["cb"][:] = np.log(c.sum(1) / c.sum())
    w["ob"][:] = np.log(c / c.sum(1, keepdims=True))
    return flat


class Lanes:
    """Documents, each ending with the token `end`, dealt to lanes of nearly equal length; all lanes stand in one flat array."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int):
        heap = [(0, k) for k in range(max(1, min(lanes, len(docs))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(heap)
            dealt[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        dealt = sorted((x for x in dealt if x), key=lambda x: -sum(len(docs[i]) for i in x))  # the lanes still running are the first
        order = [i for x in dealt for i in x]
        self.lengths = np.array([sum(len(docs[i]) for i in x) for x in dealt], np.int64)
        self.lanes = np.cumsum(self.lengths) - self.lengths
        sizes = np.array([len(docs[i]) for i in order], np.int64)
        self.order, self.starts = np.array(order, np.int64), np.cumsum(sizes) - sizes
        self.target = np.concatenate([docs[i] for i in order]) if order else np.zeros(0, np.int16)
        self.fresh = np.zeros(len(self.target), bool)
        self.fresh[self.starts] = True
        self.input = np.roll(self.target, 1)
        self.input[self.starts] = end

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(at, real), by step and lane: places in the flat arrays, and which are of the lane; others repeat its last."""
        longest = int(self.lengths.max(initial=0))
        for first in range(0, longest, length):
            live = int(np.searchsorted(-self.lengths, -first, side="left"))
            step = np.arange(first, min(first + length, longest))[:, None]
            lengths = self.lengths[None, :live]
            yield self.lanes[None, :live] + np.minimum(step, lengths - 1), step < lengths


class _Gates:
    """The weights of update, reset and new state apart, biases added to the embeddings; the first two halved for tanh."""

    def __init__(self, w: dict[str, np.ndarray]):
        cut = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
        self.u = [np.ascontiguousarray(w["u"][:, c]) for c in cut]
        self.back = [np.ascontiguousarray(u.T) for u in self.u]
        half = [0.5, 0.5, 1]
        self.e = [np.ascontiguousarray((w["e"][:, c] + w["b"][c]) * w["e"].dtype.type(k)) for c, k in zip(cut, half)]
        self.forward = [u * u.dtype.type(k) for u, k in zip(self.u, half)]


def _run(g: _Gates, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
    """States after each step (step, lane, unit); with keep also gates, new states, states before and what they add to new states."""
    z, r, n = (e[x] for e in g.e)
    out = np.empty_like(z)
    before, hn = (np.empty_like(z), np.empty_like(z)) if keep else (None, None)
    own = np.empty_like(h)
    some = fresh.any(1)
    for t in range(len(x)):
        if some[t]:
            h = h.copy()
            h[fresh[t]] = 0
        if keep:
            before[t] = h
        for gate, u in ((z[t], g.forward[0]), (r[t], g.forward[1])):
            np.dot(h, u, out=own)
            gate += own
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        new = n[t]
        np.dot(h, g.forward[2], out=own)
        if keep:
            hn[t] = own
        own *= r[t]
        new += own
        np.tanh(new, out=new)
        np.subtract(h, new, out=out[t])
        h = out[t]
        h *= z[t]
        h += new
    return out, z, r, n, before, hn


def _exp(a: np.ndarray) -> np.ndarray:
    """exp of a in place, and its sums by row; states are within -1 and 1, so logits are small."""
    np.minimum(a, 80, out=a)
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], a.dtype)


class _Softmax:
    """Probabilities of tokens y after states s: of classes, and of tokens in classes in the order of these."""

    def __init__(self, w: dict[str, np.ndarray], s: np.ndarray, y: np.ndarray):
        cls, inner = np.divmod(y, np.int16(PER_CLASS))
        self.cls = cls.astype(np.intp)
        self.order = np.argsort(cls.astype(np.int8), kind="stable")
        ends = np.cumsum(np.bincount(self.cls, minlength=CLASSES))
        self.spans = [(c, slice(int(e - n), int(e))) for c, (e, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n]
        self.inner, self.rows = inner[self.order].astype(np.intp), np.arange(len(y))
        self.states = s[self.order]
        self.p = s @ w["c"]
        self.p += w["cb"]
        self.logs = self.p[self.rows, self.cls]
        sums = _exp(self.p)
        self.logs -= np.log(sums)
        self.q = np.empty((len(y), PER_CLASS), s.dtype)
        for c, at in self.spans:
            np.dot(self.states[at], w["o"][c], out=self.q[at])
            self.q[at] += w["ob"][c]
        own = self.q[self.rows, self.inner]
        inside = _exp(self.q)
        self.logs[self.order] += own - np.log(inside)
        self.sums, self.inside = sums, inside

    def back(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Adds the gradients of the weighted loss to g, and gives that of the states."""
        self.p *= (weight / self.sums)[:, None]
        self.p[self.rows, self.cls] -= weight
        g["c"][:], g["cb"][:] = s.T @ self.p, self.p.sum(0)
        ds = self.p @ w["c"].T
        weight = weight[self.order]
        self.q *= (weight / self.inside)[:, None]
        self.q[self.rows, self.inner] -= weight
        through = np.empty_like(self.states)
        for c, at in self.spans:
            g["o"][c], g["ob"][c] = self.states[at].T @ self.q[at], self.q[at].sum(0)
            np.dot(self.q[at], w["o"][c].T, out=through[at])
        ds[self.order] += through
        return ds


def score(flat: np.ndarray, docs: list[np.ndarray], end: int, lanes: int = 512, window: int = 48) -> np.ndarray:
    """Natural log probability of each whole document."""
    w, plan = views(flat), Lanes(docs, lanes, end)
    g = _Gates(w)
    logs = np.zeros(len(plan.target), flat.dtype)
    h = np.zeros((len(plan.lanes), HIDDEN), flat.dtype)
    for at, real in plan.windows(window):
        live = at.shape[1]
        states = _run(g, plan.input[at], plan.fresh[at], h[:live], False)[0]
        h[:live] = states[-1]
        total = _Softmax(w, states.reshape(-1, HIDDEN), plan.target[at].ravel()).logs
        if real[-1].all():
            logs[at.ravel()] = total
        else:
            logs[at[real]] = total[real.ravel()]
    out = np.zeros(len(docs))
    if docs:
        out[plan.order] = np.add.reduceat(logs.astype(np.float64), plan.starts)
    return out


def gradient(flat: np.ndarray, grad: np.ndarray, plan: Lanes, at: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sets grad to that of the mean loss of one window, whose first states are h; gives its last states."""
    w, g = views(flat), views(grad)
    gates = _Gates(w)
    x, fresh = plan.input[at], plan.fresh[at]
    states, z, r, new, before, hn = _run(gates, x, fresh, h, True)
    grad[:] = 0
    s = states.reshape(-1, HIDDEN)
    weight = real.ravel() / flat.dtype.type(max(1, int(real.sum())))
    ds = _Softmax(w, s, plan.target[at].ravel()).back(w, g, s, weight.astype(flat.dtype)).reshape(states.shape)
    # what a change of the state makes of the three gates before their bends
    keep = 1 - z
    to_new, to_z, to_r = keep * (1 - new * new), (before - new) * z * keep, hn * r * (1 - r)
    dz, dr, dn, dnr = (np.empty_like(z) for _ in range(4))
    dh, part = np.zeros_like(h), np.empty_like(h)
    some = fresh.any(1)
    for t in range(len(ds) - 1, -1, -1):
        dh += ds[t]
        np.multiply(dh, to_new[t], out=dn[t])
        np.multiply(dh, to_z[t], out=dz[t])
        np.multiply(dn[t], to_r[t], out=dr[t])
        np.multiply(dn[t], r[t], out=dnr[t])
        dh *= z[t]
        for d, u in ((dz, gates.back[0]), (dr, gates.back[1]), (dnr, gates.back[2])):
            np.dot(d[t], u, out=part)
            dh += part
        if some[t]:
            dh[fresh[t]] = 0
    ids, b = x.ravel(), before.reshape(-1, HIDDEN)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    for k, (d, through) in enumerate(((dz, dz), (dr, dr), (dn, dnr))):
        cut = slice(k * HIDDEN, (k + 1) * HIDDEN)
        g["u"][:, cut] = b.T @ through.reshape(-1, HIDDEN)
        g["e"][ids[order[first]], cut] = np.add.reduceat(d.reshape(-1, HIDDEN)[order], first, axis=0)
        g["b"][cut] = d.sum((0, 1))
    return states[-1]


def train(flat: np.ndarray, docs: list[np.ndarray], end: int, rate: float, lanes: int = 256, window: int = 48, clip: float = 1.0) -> int:
    """One pass of Adam over whole documents, truncated at windows; changes flat and returns the tokens seen."""
    plan = Lanes(docs, lanes, end)
    grad, m, v = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    h = np.zeros((len(plan.lanes), HIDDEN), flat.dtype)
    for step, (at, real) in enumerate(plan.windows(window), 1):
        h[: at.shape[1]] = gradient(flat, grad, plan, at, real, h[: at.shape[1]])
        grad *= min(1.0, clip / (float(np.sqrt(grad @ grad)) + 1e-9))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        few = min(1.0, int(real.sum()) / (lanes * window))  # short windows at the end of the lanes count for less
        flat -= (rate * few / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return int(plan.lengths.sum())
