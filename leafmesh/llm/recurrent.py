"""A bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A sample is a row of unit numbers; a unit is a word, with a word bucket and the buckets of its characters. The mean of the
character vectors stands beside the word vector. Rows are padded at the end with unit 0, which no state passes over.
"""

from __future__ import annotations

import numpy as np

WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 24, 24, 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 13


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Weights by name; the inputs of both directions are projected by one matrix."""

    def __init__(self, seed: int = 1) -> None:
        draw = np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return (draw.standard_normal(shape) * by).astype(np.float32)

        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.weights = {
            "word": normal(WORD_BUCKETS, WORD_DIM, by=0.1), "char": normal(CHAR_BUCKETS, CHAR_DIM, by=0.3),
            "x": normal(d, 6 * h, by=d**-0.5), "bx": np.zeros(6 * h, np.float32),
            "u0": normal(h, 3 * h, by=h**-0.5), "u1": normal(h, 3 * h, by=h**-0.5),
            "a": normal(2 * h, ATTENTION, by=(2 * h) ** -0.5), "v": normal(ATTENTION, by=ATTENTION**-0.5),
            "o": normal(2 * h, by=(2 * h) ** -0.5), "b": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: np.ndarray, chars: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Vectors of units: the word's, and the mean of its characters'; owner gives the unit of each character."""
        n = len(words)
        mean = np.zeros((n, CHAR_DIM), np.float32)
        np.add.at(mean, owner, self.weights["char"][chars])
        mean /= np.maximum(1, np.bincount(owner, minlength=n))[:, None].astype(np.float32)
        return np.concatenate([self.weights["word"][words], mean], axis=1)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights["x"] + self.weights["bx"]

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
        n, steps = mask.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            g, hu = gates[:, t], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (c - h)
            out[:, t] = h
        return out

    def logits(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each row of projected units of shape (rows, steps, 6 * HIDDEN)."""
        w = self.weights
        tapes: tuple[list | None, list | None] = (None, None) if keep is None else ([], [])
        h = np.concatenate([
            self._run(gates[:, :, : 3 * HIDDEN], mask, w["u0"], False, tapes[0]),
            self._run(gates[:, :, 3 * HIDDEN :], mask, w["u1"], True, tapes[1]),
        ], axis=2)
        t = np.tanh(h @ w["a"])
        s = np.where(mask > 0, t @ w["v"], np.float32(-1e9))
        e = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        alpha = e / np.maximum(e.sum(axis=1, keepdims=True), np.float32(1e-9))
        pooled = np.einsum("nt,nth->nh", alpha, h)
        if keep is not None:
            keep.update(h=h, t=t, alpha=alpha, pooled=pooled, tapes=tapes, mask=mask)
        return pooled @ w["o"] + w["b"][0]

    def _back(self, dh_out: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, steps, _ = dh_out.shape
        dgates, du, dh = np.zeros((n, steps, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, c, hc, m in reversed(tape):
            dh = dh + dh_out[:, t]
            da = dh * m
            dc = da * (1 - z) * (1 - c * c)
            dz = -da * (c - h) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dgates[:, t] = np.concatenate([dz, dr, dc], axis=1)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = dh - da * (1 - z) + dhu @ u.T
        return dgates, du

    def gradients(self, rows: np.ndarray, words: np.ndarray, chars: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted logistic loss over rows of unit numbers and its gradients; units are those of the batch."""
        w = self.weights
        x = self.inputs(words, chars, owner)
        gates = self.projected(x)[rows]
        mask = (rows > 0).astype(np.float32)
        keep: dict = {}
        logit = self.logits(gates, mask, keep)
        p = _sigmoid(logit)
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
        dl = (weight * (p - y) / len(y)).astype(np.float32)
        h, t, alpha, pooled = keep["h"], keep["t"], keep["alpha"], keep["pooled"]
        g = {"o": pooled.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dpooled = dl[:, None] * w["o"]
        dalpha = np.einsum("nh,nth->nt", dpooled, h)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        dt = ds[:, :, None] * w["v"] * (1 - t * t)
        g["v"] = np.einsum("nt,nta->a", ds, t)
        g["a"] = np.einsum("nth,nta->ha", h, dt)
        dh = alpha[:, :, None] * dpooled[:, None, :] + dt @ w["a"].T
        d0, g["u0"] = self._back(dh[:, :, :HIDDEN], keep["tapes"][0], w["u0"])
        d1, g["u1"] = self._back(dh[:, :, HIDDEN:], keep["tapes"][1], w["u1"])
        flat = np.concatenate([d0, d1], axis=2).reshape(-1, 6 * HIDDEN)
        dproj = np.zeros((len(words), 6 * HIDDEN), np.float32)
        order = np.argsort(rows.ravel(), kind="stable")
        units, first = np.unique(rows.ravel()[order], return_index=True)
        dproj[units] = np.add.reduceat(flat[order], first, axis=0)
        dproj[0] = 0
        g["x"], g["bx"] = x.T @ dproj, dproj.sum(axis=0)
        dx = dproj @ w["x"].T
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], words, dx[:, :WORD_DIM])
        share = dx[:, WORD_DIM:] / np.maximum(1, np.bincount(owner, minlength=len(words)))[:, None].astype(np.float32)
        np.add.at(g["char"], chars, share[owner])
        return loss, g


class Adam:
    """Adam; rows of the embedding tables without a gradient are left alone."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.weights, self.rate, self.decay, self.step = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 2.0 / max(norm, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            at = np.flatnonzero(np.abs(g).sum(axis=1)) if k in ("word", "char") else slice(None)
            g = g[at] * np.float32(clip)
            m = self.m[k][at] = np.float32(0.9) * self.m[k][at] + np.float32(0.1) * g
            v = self.v[k][at] = np.float32(0.999) * self.v[k][at] + np.float32(0.001) * g * g
            self.weights[k][at] -= (rate * m / (np.sqrt(v) + 1e-8) + self.rate * self.decay * self.weights[k][at]).astype(np.float32)


__all__ = ["Adam", "CHAR_BUCKETS", "HIDDEN", "Network", "WORD_BUCKETS"]
