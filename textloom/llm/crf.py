"""Conditional random fields over sequences of typed tokens, in numpy.

A token has a *type*: a list of feature numbers. The score of a label at a token is the sum of the
weights of the features at it and around it, by offset. The scores of a type are computed
once and looked up after, so reading a text costs a look-up a token. Forward and backward passes run
over many sequences at once, step by step, as small matrix products in the probability domain.

*Skip edges* between two tokens share a potential (a skip-chain field). Inference is then loopy
sum-product: a forward-backward pass over each chain, messages along its skip edges, and again for those
chains whose messages moved, until none does. Should messages swing, they are damped from the round on by which one could
have walked along all edges of its chain, and stop after as many again.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np


SURE = 0.98


class Field:
    """Weights of a chain field with types as features: W[offset, feature, label], transitions and start."""

    def __init__(self, labels: Sequence[str], offsets: Sequence[int], n_features: int) -> None:
        self.labels, self.offsets = list(labels), list(offsets)
        size = len(self.labels)
        self.w = np.zeros((len(self.offsets), n_features, size), np.float32)
        self.trans = np.zeros((size, size), np.float32)
        self.start = np.zeros(size, np.float32)
        self.skip: np.ndarray | None = None  # potential of a skip edge, symmetric, as factors


def ragged(types: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of many types as one array and where each type's begin; feature 0 is no feature."""
    flat = np.fromiter((f for t in types for f in (t or (0,))), np.int64)
    starts = np.cumsum([0] + [len(t) or 1 for t in types])[:-1]
    return flat, starts


class Scores:
    """Label scores of token types, kept by type for the life of a worker."""

    def __init__(self, field: Field, features: Callable[[Hashable], Sequence[int]], most: int = 400_000) -> None:
        self.field, self.features, self.most = field, features, most
        self.number: dict[Hashable, int] = {}
        self.table = np.zeros((1, len(field.offsets), len(field.labels)), np.float32)
        self.used = 1  # type 0 is the padding between sequences

    def types(self, keys: Sequence[Hashable]) -> np.ndarray:
        """Numbers of the keys' types; new ones are scored. The table starts afresh when it is full."""
        number = self.number
        try:
            return np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
        except KeyError:
            pass
        new = [k for k in dict.fromkeys(keys) if k not in number]
        if new:
            if self.used + len(new) > self.most and self.used > 1:
                number.clear()
                self.used = 1
                new = list(dict.fromkeys(keys))
            flat, starts = ragged([self.features(k) for k in new])
            rows = np.add.reduceat(self.field.w[:, flat], starts, axis=1).transpose(1, 0, 2)
            if self.used + len(new) > len(self.table):
                grown = np.zeros((2 * (self.used + len(new)), *self.table.shape[1:]), np.float32)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : self.used + len(new)] = rows
            for i, k in enumerate(new):
                number[k] = self.used + i
            self.used += len(new)
        return np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))

    def unary(self, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (token, label) of sequences laid end to end; no sequence sees into another."""
        far = max(map(abs, self.field.offsets))
        # Laid out with padding between the sequences, a neighbour is a shift of the whole.
        place = np.arange(len(types)) + far * (1 + np.repeat(np.arange(len(lengths)), lengths))
        padded = np.zeros(len(types) + far * (len(lengths) + 1), np.int64)
        padded[place] = types
        out = np.zeros((len(padded), len(self.field.labels)), np.float32)
        for j, off in enumerate(self.field.offsets):
            part = self.table[:, j].take(padded, axis=0)
            if off < 0:
                out[-off:] += part[:off]
            elif off > 0:
                out[:-off] += part[off:]
            else:
                out += part
        return out[place]


class Chains:
    """The order in which many sequences, laid end to end, are walked together: step by step, longest first, so that
    the tokens of one step are one block and the sequences still running are its first rows."""

    def __init__(self, lengths: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
        self.block = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        step = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        self.place = self.block[step] + np.repeat(rank, lengths)  # of each token

    def marginals(self, field: Field, psi: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Label marginals of each token and the log partition. psi: factors > 0 of each token's labels.
        ``pairs`` gets the expected number of each transition added."""
        m = np.exp(field.trans)
        mt = np.ascontiguousarray(m.T)
        ones = np.ones(psi.shape[1], np.float32)
        local = np.empty_like(psi)
        local[self.place] = psi
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        log_z, lo = 0.0, self.block.tolist()
        for t, n in enumerate(self.active.tolist()):
            here = slice(lo[t], lo[t] + n)
            a = local[here] * (np.exp(field.start) if t == 0 else alpha[lo[t - 1] : lo[t - 1] + n] @ m)
            z = a @ ones
            np.divide(a, z[:, None], out=alpha[here])
            if pairs is not None:
                log_z += float(np.log(z).sum())
        for t in range(len(self.active) - 1, 0, -1):
            n = int(self.active[t])
            here, before = slice(lo[t], lo[t] + n), slice(lo[t - 1], lo[t - 1] + n)
            b = local[here] * beta[here]
            if pairs is not None:
                z = ((alpha[before] @ m) * b) @ ones
                pairs += m * (alpha[before].T @ (b / z[:, None]))
            back = b @ mt
            np.divide(back, (back @ ones)[:, None], out=beta[before])
        alpha *= beta
        alpha /= (alpha @ ones)[:, None]
        return alpha[self.place], log_z


def factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))


def infer(field: Field, unary: np.ndarray, lengths: np.ndarray, edges: np.ndarray | None = None, tolerance: float = 0.02) -> np.ndarray:
    """Marginals (token, label) of sequences laid end to end. edges: (2, n) tokens joined by skip edges, both of one sequence."""
    psi = factors(unary)
    lengths = np.asarray(lengths, np.int64)
    belief, _ = Chains(lengths[lengths > 0] if len(lengths) else lengths).marginals(field, psi)
    if edges is None or not edges.shape[1] or field.skip is None:
        return belief
    # Ends that are sure of the same label have nothing to tell each other.
    sure, best = belief.max(axis=1) > SURE, belief.argmax(axis=1)
    edges = edges[:, ~(sure[edges[0]] & sure[edges[1]] & (best[edges[0]] == best[edges[1]]))]
    if not edges.shape[1]:
        return belief
    i, j = edges
    starts = np.cumsum(lengths) - lengths
    seq = np.repeat(np.arange(len(lengths)), lengths)
    to_j, to_i = np.ones((len(i), psi.shape[1]), np.float32), np.ones((len(i), psi.shape[1]), np.float32)
    live = np.arange(len(i))
    walk = np.bincount(seq[i], minlength=len(lengths)) + 2  # rounds after which a message has gone along every edge of its chain
    turn = 0
    while True:
        turn += 1
        live = live[turn <= 2 * walk[seq[i[live]]]]
        if not len(live):
            break
        new_j = _message(belief[i[live]], to_i[live], field.skip)
        new_i = _message(belief[j[live]], to_j[live], field.skip)
        late = turn > walk[seq[i[live]]]
        if late.any():
            new_j[late] = np.sqrt(new_j[late] * to_j[live][late])
            new_i[late] = np.sqrt(new_i[late] * to_i[live][late])
        moved = (np.abs(new_j - to_j[live]).max(axis=1) > tolerance) | (np.abs(new_i - to_i[live]).max(axis=1) > tolerance)
        if not moved.any():
            break
        to_j[live], to_i[live] = new_j, new_i
        chains = np.unique(seq[i[live[moved]]])  # only these are passed again
        again = np.zeros(len(lengths), bool)
        again[chains] = True
        own = lengths[chains]
        tokens = np.repeat(starts[chains] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        place = np.full(len(psi), -1)
        place[tokens] = np.arange(len(tokens))
        local = psi[tokens].copy()
        of = np.flatnonzero(again[seq[i]])
        logs = np.zeros_like(local)
        np.add.at(logs, place[j[of]], np.log(to_j[of]))
        np.add.at(logs, place[i[of]], np.log(to_i[of]))
        belief[tokens], _ = Chains(own).marginals(field, local * factors(logs))
        live = of
    return belief


def _message(belief: np.ndarray, back: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """What a token tells its partner: its belief without what the partner told it, through the edge."""
    m = (belief / np.maximum(back, 1e-6)) @ skip
    return np.maximum(m / m.max(axis=1, keepdims=True), 1e-4).astype(np.float32)


class _Sums:
    """Sums of rows by group."""

    def __init__(self, group: np.ndarray, size: int) -> None:
        self.order = np.argsort(group, kind="stable")
        self.present, self.starts = np.unique(group[self.order], return_index=True)
        self.size = size

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), np.float32)
        if len(self.order):
            out[self.present] = np.add.reduceat(rows[self.order], self.starts, axis=0)
        return out


class _Batch:
    """Labelled sequences with what a training step needs of them."""

    def __init__(self, field: Field, features: list[tuple[int, ...]], y: np.ndarray, lengths: np.ndarray) -> None:
        size, n = len(field.labels), len(y)
        keys: dict[tuple[int, ...], int] = {}
        self.types = np.array([keys.setdefault(f, len(keys)) for f in features])
        self.flat, self.starts = ragged(list(keys))
        self.owner = np.repeat(np.arange(len(keys)), np.diff(np.append(self.starts, len(self.flat))))
        at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        of = np.repeat(lengths, lengths)
        self.there = [np.flatnonzero((at + o >= 0) & (at + o < of)) for o in field.offsets]
        self.shifted = [self.types[t + o] for t, o in zip(self.there, field.offsets, strict=True)]
        self.by_type = [_Sums(x, len(keys)) for x in self.shifted]
        self.by_feature = _Sums(self.flat, field.w.shape[1])
        self.begin, inner = np.flatnonzero(at == 0), np.flatnonzero(at > 0)
        self.onehot = np.eye(size, dtype=np.float32)[y]
        self.seen = np.zeros((size, size), np.float32)
        np.add.at(self.seen, (y[inner - 1], y[inner]), 1)
        self.chains, self.n = Chains(lengths), n

    def gradient(self, field: Field) -> list[np.ndarray]:
        table = np.add.reduceat(field.w[:, self.flat], self.starts, axis=1)
        scores = np.zeros(self.onehot.shape, np.float32)
        for j, (t, x) in enumerate(zip(self.there, self.shifted, strict=True)):
            scores[t] += table[j, x]
        pairs = np.zeros_like(self.seen)
        belief, _ = self.chains.marginals(field, factors(scores), pairs)
        miss = self.onehot - belief
        gw = np.stack([self.by_feature(s(miss[t])[self.owner]) for s, t in zip(self.by_type, self.there, strict=True)])
        gw[:, 0] = 0
        return [gw / self.n, (self.seen - pairs) / self.n, miss[self.begin].sum(axis=0) / self.n]


def train(field: Field, features: Sequence[Sequence[int]], labels: Sequence[int], lengths: Sequence[int], *, epochs: int = 12, batch: int = 150, rate: float = 0.08, l2: float = 1e-4) -> None:
    """Fits the field to labelled sequences laid end to end: Adam on the likelihood of batches of sequences,
    with a falling rate. Sequences are taken in the order given, so they should be mixed."""
    y, sizes = np.asarray(labels, np.int64), np.asarray([n for n in lengths if n], np.int64)
    ends = np.cumsum(sizes)
    batches = []
    for k in range(0, len(sizes), batch):
        own = sizes[k : k + batch]
        hi = int(ends[min(k + batch, len(sizes)) - 1])
        lo = hi - int(own.sum())
        batches.append(_Batch(field, [tuple(f) for f in features[lo:hi]], y[lo:hi], own))
    params = [field.w, field.trans, field.start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in batches:
            step += 1
            now = rate * (1 - 0.95 * step / total)
            for k, (p, g) in enumerate(zip(params, b.gradient(field), strict=True)):
                g = g - l2 * p
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p += now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
