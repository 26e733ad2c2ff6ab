"""A linear-chain conditional random field on dense features and hashed n-grams, trained and decoded in numpy batches."""

from __future__ import annotations

import numpy as np


class ChainCRF:
    """Emissions are linear in dense features and in bags of hashed n-grams; transitions are one table.

    Sequences are padded with a mask.  The n-grams of all unpadded steps, in order, are ``(starts, columns)``: where each step's
    run begins, and the columns of all runs; a step's n-grams share a weight of 1.
    """

    def __init__(self, features: int, labels: int, grams: int = 0):
        self.w = np.zeros((features, labels))
        self.t = np.zeros((labels, labels))
        self.g = np.zeros((grams, labels))

    @staticmethod
    def _weights(starts: np.ndarray) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.diff(starts), 1))

    def gram_scores(self, starts: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Emissions of the n-grams, one row per step."""
        out = np.zeros((len(starts) - 1, self.g.shape[1]))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            table = self.g.astype(np.float32)
            out[some] = np.add.reduceat(table[columns], starts[:-1][some])
        return out * self._weights(starts)[:, None]

    def emissions(self, x: np.ndarray, mask: np.ndarray, grams: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        e = x @ self.w
        if grams is not None:
            e[mask] += self.gram_scores(*grams)
        return e

    @staticmethod
    def _lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    def _expectations(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and the summed marginals of transitions (forward-backward)."""
        n, steps, labels = e.shape
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for s in range(1, steps):
            step = self._lse(a[:, s - 1, :, None] + self.t, 1) + e[:, s]
            a[:, s] = np.where(mask[:, s, None], step, a[:, s - 1])
        z = self._lse(a[:, -1], 1)
        b = np.zeros_like(e)
        pairs = np.zeros_like(self.t)
        for s in range(steps - 2, -1, -1):
            nxt = e[:, s + 1] + b[:, s + 1]
            b[:, s] = np.where(mask[:, s + 1, None], self._lse(self.t + nxt[:, None, :], 2), b[:, s + 1])
            p = np.exp(a[:, s, :, None] + self.t + nxt[:, None, :] - z[:, None, None])
            pairs += p[mask[:, s + 1]].sum(0)
        return np.exp(a + b - z[:, None, None]) * mask[..., None], pairs

    def fit(
        self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, grams: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 100, rate: float = 0.4, l2: float = 1e-5, gram_l2: float = 1e-4
    ) -> "ChainCRF":
        """Maximum likelihood by Adam with a falling rate; x is (n, t, features), y (n, t) labels, mask (n, t)."""
        gold = np.eye(self.t.shape[0])[y] * mask[..., None]
        both = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1))
        count, flat = max(mask.sum(), 1), x.reshape(-1, x.shape[-1])
        params, m, v = [self.w, self.t, self.g], [0.0] * 3, [0.0] * 3
        for i in range(1, steps + 1):
            p, pairs = self._expectations(self.emissions(x, mask, grams), mask)
            grads = [flat.T @ (gold - p).reshape(len(flat), -1) / count - l2 * self.w, (both - pairs) / count - l2 * self.t]
            if grams is not None:
                each = np.repeat((gold - p)[mask] * self._weights(grams[0])[:, None], np.diff(grams[0]), axis=0)
                slope = np.stack([np.bincount(grams[1], each[:, k], len(self.g)) for k in range(self.g.shape[1])], axis=1)
                grads.append(slope / count - gram_l2 * self.g)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] += rate * (1 - (i - 1) / steps) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self

    def decode(self, x: np.ndarray, mask: np.ndarray, grams: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The most probable labels (Viterbi); padding repeats the last label."""
        e = self.emissions(x, mask, grams)
        n, steps, labels = e.shape
        best, back = e[:, 0], np.zeros((n, steps, labels), np.int64)
        for s in range(1, steps):
            all_ = best[:, :, None] + self.t
            back[:, s] = np.where(mask[:, s, None], all_.argmax(1), np.arange(labels))
            best = np.where(mask[:, s, None], all_.max(1) + e[:, s], best)
        out = np.zeros((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for s in range(steps - 1, 0, -1):
            out[:, s - 1] = np.take_along_axis(back[:, s], out[:, s, None], 1)[:, 0]
        return out
