"""A linear-chain conditional random field over two labels, trained and decoded in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Scores of labels by feature, of label pairs, and of the first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi) for rows of features; ties go to label 0."""
        if not len(x):
            return np.zeros(0, np.int64)
        e = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            to0, to1 = (a + s00 < b + s10), (a + s01 < b + s11)
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        label = int(b > a)
        out = [label]
        for to in reversed(back):
            label = int(to[label])
            out.append(label)
        return np.array(out[::-1], np.int64)


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 180, rate: float = 0.15, ridge: float = 4e-4) -> Chain:
    """Pages are (features, labels) of their blocks in order; maximises the penalised likelihood by Adam."""
    pages = sorted(((x, y) for x, y in pages if len(y)), key=lambda page: -len(page[1]))
    t, f = len(pages[0][1]), pages[0][0].shape[1]
    live = [sum(len(y) > i for _, y in pages) for i in range(t)]  # the first so many pages have a block i
    y = np.zeros((len(pages), t), np.int64)
    on = np.zeros((len(pages), t))
    for i, (a, b) in enumerate(pages):
        y[i, : len(b)], on[i, : len(b)] = b, 1
    there = on > 0
    x = np.concatenate([a for a, _ in pages]).astype(np.float64)  # rows of the blocks there are, page by page
    theta = [np.zeros((f, 2)), np.zeros((2, 2)), np.zeros(2)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in theta]
    gold = np.eye(2)[y] * on[..., None]
    pairs = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    counted = [x.T @ gold[there], pairs, gold[:, 0].sum(0)]
    n = on.sum()

    def soft(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        emit, step, first = theta
        e = np.zeros((len(pages), t, 2))
        e[there] = x @ emit
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = first + e[:, 0]
        for i in range(1, t):
            m = live[i]
            ahead[:m, i] = soft(ahead[:m, i - 1, :, None] + step, 1) + e[:m, i]
            ahead[m:, i] = ahead[m:, i - 1]
        for i in range(t - 2, -1, -1):
            m = live[i + 1]
            behind[:m, i] = soft(step + (e[:m, i + 1] + behind[:m, i + 1])[:, None, :], 2)
        total = soft(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None]) * on[..., None]
        double = np.exp(ahead[:, :-1, :, None] + step + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
        expected = [x.T @ single[there], double.sum((0, 1)), single[:, 0].sum(0)]
        for p, want, have, m in zip(theta, counted, expected, moment):
            g = (want - have) / n - ridge * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.999**r)) + 1e-8)
    return Chain(*theta)
