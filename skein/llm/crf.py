"""Linear-chain conditional random fields over batches of padded sequences.

Arrays: ``emit`` (sequences, steps, labels) log scores, ``trans`` (labels,
labels) log scores from row to column, ``start`` (labels,), ``valid``
(sequences, steps) with padding at the end.
"""

from __future__ import annotations

import numpy as np


def forward_backward(emit, trans, start, valid, pairs: bool = False):
    """Label marginals; with ``pairs`` also the expected transition counts."""
    n, steps, labels = emit.shape
    move = np.exp(trans - trans.max())
    scores = np.exp(emit - emit.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(scores), np.ones_like(scores)
    now = scores[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[:, t - 1] @ move) * scores[:, t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    for t in range(steps - 2, -1, -1):
        now = (scores[:, t + 1] * beta[:, t + 1]) @ move.T
        now /= now.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(valid[:, t + 1, None], now, 1)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    if not pairs:
        return marginal
    expected = np.zeros((labels, labels))
    for t in range(1, steps):
        on = valid[:, t]
        left, right = alpha[on, t - 1], scores[on, t] * beta[on, t]
        total = np.einsum("ni,ij,nj->n", left, move, right)
        expected += move * np.einsum("ni,nj->ij", left / total[:, None], right)
    return marginal, expected


def viterbi(emit, trans, start, valid):
    """The best label sequence of each row; padding repeats the last label."""
    n, steps, labels = emit.shape
    score, back = emit[:, 0] + start, np.zeros((n, steps, labels), dtype=np.int16)
    stay = np.arange(labels)
    for t in range(1, steps):
        all_ = score[:, :, None] + trans[None]
        best = all_.argmax(axis=1)
        on = valid[:, t, None]
        score = np.where(on, np.take_along_axis(all_, best[:, None], 1)[:, 0] + emit[:, t], score)
        back[:, t] = np.where(on, best, stay)
    path = np.zeros((n, steps), dtype=np.int64)
    path[:, -1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path
