"""A linear-chain conditional random field in numpy: forward-backward for training, Viterbi for tagging.

Sequences come as one array of emissions with their lengths; they are worked in groups of like length, padded at the end.
"""

from __future__ import annotations

import numpy as np


def _groups(lengths: np.ndarray, most: int = 4096) -> list[np.ndarray]:
    order = np.argsort(lengths, kind="stable")
    rising = lengths[order]
    out, a = [], 0
    while a < len(order):
        longest = max(1, int(rising[a]))
        z = min(a + most, int(np.searchsorted(rising, longest + longest // 4, "right")))
        out.append(order[a:z])
        a = z
    return out


def _padded(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = int(lengths.max())
    at = starts[:, None] + np.minimum(np.arange(steps), np.maximum(lengths - 1, 0)[:, None])
    return emit[at], at, np.arange(steps) < lengths[:, None]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Chain:
    """Transition scores between tags, with scores of the first and last tag."""

    def __init__(self, tags: int) -> None:
        self.first, self.last, self.step = np.zeros(tags), np.zeros(tags), np.zeros((tags, tags))

    def tag(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag of every position; sequences of no position give none."""
        out = np.zeros(len(emit), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        for g in _groups(lengths):
            g = g[lengths[g] > 0]
            if not len(g):
                continue
            e, at, there = _padded(emit, starts[g], lengths[g])
            n, steps, tags = e.shape
            score, back = self.first + e[:, 0], np.zeros((n, steps, tags), dtype=np.int64)
            for t in range(1, steps):
                cand = score[:, :, None] + self.step
                back[:, t] = cand.argmax(axis=1)
                score = np.where(there[:, t, None], cand.max(axis=1) + e[:, t], score)
            best = (score + self.last).argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                rows = np.flatnonzero(there[:, t])
                out[at[rows, t]] = best[rows]
                if t:
                    best = np.where(there[:, t], back[np.arange(n), t, best], best)
        return out

    def gradients(self, emit: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """The mean negative log-likelihood and its gradients by emissions and by transitions."""
        starts = np.cumsum(lengths) - lengths
        loss, de = 0.0, np.zeros_like(emit)
        grads = {"first": np.zeros_like(self.first), "last": np.zeros_like(self.last), "step": np.zeros_like(self.step)}
        for g in _groups(lengths):
            g = g[lengths[g] > 0]
            if not len(g):
                continue
            e, at, there = _padded(emit, starts[g], lengths[g])
            n, steps, k = e.shape
            alpha, beta = np.zeros((steps, n, k)), np.zeros((steps, n, k))
            alpha[0] = self.first + e[:, 0]
            for t in range(1, steps):
                alpha[t] = np.where(there[:, t, None], _logsum(alpha[t - 1][:, :, None] + self.step, 1) + e[:, t], alpha[t - 1])
            beta[steps - 1] = self.last
            for t in range(steps - 2, -1, -1):
                onward = _logsum(self.step[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(there[:, t + 1, None], onward, self.last)
            z = _logsum(alpha[steps - 1] + self.last, 1)
            y = tags[at]
            i = np.arange(n)
            gold = self.first[y[:, 0]] + e[i, 0, y[:, 0]] + self.last[y[i, lengths[g] - 1]]
            for t in range(1, steps):
                gold = gold + np.where(there[:, t], self.step[y[:, t - 1], y[:, t]] + e[i, t, y[:, t]], 0)
            loss += float((z - gold).sum())
            for t in range(steps):
                m = np.exp(alpha[t] + beta[t] - z[:, None]) * there[:, t, None]
                # each sequence has its own rows, so none is met twice
                m[i, y[:, t]] -= there[:, t]
                de[at[:, t]] += m
                if t == 0:
                    grads["first"] += m.sum(axis=0)
                is_last = (lengths[g] - 1 == t)[:, None]
                grads["last"] += (m * is_last).sum(axis=0)
                if t:
                    two = np.exp(alpha[t - 1][:, :, None] + self.step + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]) * there[:, t, None, None]
                    grads["step"] += two.sum(axis=0)
                    np.add.at(grads["step"], (y[there[:, t], t - 1], y[there[:, t], t]), -1.0)
        n = max(1, len(lengths))
        return loss / n, de / n, {k: v / n for k, v in grads.items()}


__all__ = ["Chain"]
