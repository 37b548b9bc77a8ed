"""Linear-chain conditional random fields with numpy: forward-backward over many sequences at once, and training."""

from __future__ import annotations

import numpy as np

#: Positions that the scans step through at once; sequences are cut into chunks of it, without loss.
CHUNK = 64


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sequences at offsets ``first``: each chunk's start, length, number in its sequence, sequence."""
    length = np.diff(first)
    many = -(-length // CHUNK)
    seq = np.repeat(np.arange(len(length)), many)
    at = np.concatenate([[0], np.cumsum(many)])
    number = np.arange(len(seq)) - at[seq]
    start = first[seq] + number * CHUNK
    return start, np.minimum(CHUNK, first[seq + 1] - start), number, seq


def marginals(scores: np.ndarray, trans: np.ndarray, begin: np.ndarray, first: np.ndarray, pairs: bool = False):
    """P(label) of every position; with ``pairs`` also the expected transition counts and the log-likelihood's log Z.

    Chunks of all sequences go in step. A chunk is a product of K x K operators; messages pass from chunk to chunk
    by these, then every chunk is filled in from its own messages, so long sequences take no longer scans.
    """
    n, k = scores.shape
    if not n:
        return (scores, np.zeros((k, k)), 0.0) if pairs else scores
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    move, eye = np.exp(trans - trans.max()), np.eye(k)
    start, length, number, seq = _chunks(first)
    count, steps = len(start), int(length.max())
    last = np.zeros(n, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    logz = 0.0

    through = np.broadcast_to(eye, (count, k, k)).copy()
    scale = np.zeros(count)
    for t in range(steps):
        on = np.flatnonzero(length > t)
        p = start[on] + t
        m = (through[on] * e[p][:, None, :]) @ move
        end = last[p]
        if end.any():
            m[end] = through[on[end]] * e[p[end]][:, None, :]
        s = m.max(axis=(1, 2))
        through[on] = m / s[:, None, None]
        scale[on] += np.log(s)

    inward, outward = np.zeros((count, k)), np.ones((count, k))
    heads = np.flatnonzero(number == 0)
    inward[heads] = np.exp(begin - begin.max())
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(number.max() + 2))
    for c in range(1, number.max() + 1):
        on = order[cuts[c] : cuts[c + 1]]
        v = np.einsum("ni,nij->nj", inward[on - 1], through[on - 1])
        s = v.sum(axis=1, keepdims=True)
        inward[on] = v / s
        logz += float(np.log(s).sum())
    for c in range(number.max() - 1, -1, -1):
        on = order[cuts[c] : cuts[c + 1]]
        on = on[np.append(seq[1:], -1)[on] == seq[on]]
        v = np.einsum("nij,nj->ni", through[on + 1], outward[on + 1])
        outward[on] = v / v.sum(axis=1, keepdims=True)
    if pairs:
        tails = np.append(seq[1:] != seq[:-1], True)
        logz += float(np.log(np.einsum("ni,nij,nj->n", inward[tails], through[tails], outward[tails])).sum()) + float(scale.sum())
        logz += float(top.sum()) + trans.max() * float((~last).sum()) + begin.max() * len(heads)

    forward = np.empty((n, k))
    m = inward.copy()
    for t in range(steps):
        on = np.flatnonzero(length > t)
        p = start[on] + t
        forward[p] = m[on]
        v = (m[on] * e[p]) @ move
        m[on] = v / v.sum(axis=1, keepdims=True)
    out = np.empty((n, k))
    counts = np.zeros((k, k))
    r = outward.copy()
    for t in range(steps - 1, -1, -1):
        on = np.flatnonzero(length > t)
        p = start[on] + t
        q = np.where(last[p][:, None], 1.0, r[on] @ move.T)
        a = forward[p] * e[p]
        g = a * q
        s = g.sum(axis=1, keepdims=True)
        out[p] = g / s
        if pairs:
            inner = ~last[p]
            counts += ((a / s)[inner].T @ r[on][inner]) * move
        v = e[p] * q
        r[on] = v / v.sum(axis=1, keepdims=True)
    return (out, counts, logz) if pairs else out


class Model:
    """Weights of features, transitions and starts over ``labels``."""

    def __init__(self, labels: list, weights: np.ndarray, trans: np.ndarray, begin: np.ndarray):
        self.labels, self.weights, self.trans, self.begin = labels, weights, trans, begin

    def scores(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of the weights of each position's features, given as one list with offsets."""
        return row_sums(self.weights[feature], first)


def row_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, rows.shape[1]))
    some = np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(rows, first[:-1][some], axis=0)
    return out


def fit(labels: list, size: int, feature: np.ndarray, at: np.ndarray, item: np.ndarray, first: np.ndarray, gold: np.ndarray, epochs: int = 40, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximise the conditional likelihood by Adam over all sequences.

    ``feature`` with offsets ``at`` lists the features of each distinct item; ``item`` names the item at each
    position of the sequences at offsets ``first``; ``gold`` has its label.
    """
    k, n = len(labels), len(item)
    params = [np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hot = np.zeros((n, k))
    hot[np.arange(n), gold] = 1
    last = np.zeros(n, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    heads = first[:-1][np.diff(first) > 0]
    go = np.flatnonzero(~last)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[go], gold[go + 1]), 1)
    for step in range(1, epochs + 1):
        s = row_sums(params[0][feature], at)[item]
        p, expected, _ = marginals(s, params[1], params[2], first, pairs=True)
        gap = hot - p
        by_item = np.stack([np.bincount(item, gap[:, j], len(at) - 1) for j in range(k)], axis=1)
        grad = [np.stack([np.bincount(feature, by_item[owner, j], size) for j in range(k)], axis=1), seen - expected, gap[heads].sum(axis=0)]
        for i, g in enumerate(grad):
            g = g / n - decay * params[i] * (1 if i else 0.1)
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] = params[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-9)
    return Model(labels, params[0], params[1], params[2])
