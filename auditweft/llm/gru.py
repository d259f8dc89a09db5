"""Bidirectional gated recurrent network with attention pooling, forward and backward passes in numpy.

Inputs of a word are three embedding sums: of the word, of its opening byte n-grams and of all its
byte n-grams, each hashed into buckets. Both directions read a window of words; attention weights
their states; one unit gives the window's logit.
"""

from __future__ import annotations

import numpy as np

from .words import ngram_buckets

BUCKETS = 1 << 16
EMB, HID, ATT = 6, 8, 8


def inputs_of(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket ids and word starts of the three inputs: word, opening n-grams, n-grams."""
    return [
        ngram_buckets(words, (), BUCKETS, whole=True),
        ngram_buckets(words, (), BUCKETS, start_only=(4, 5, 6, 7, 8), whole=True),
        ngram_buckets(words, (3, 4, 5), BUCKETS, whole=True),
    ]


def _sums(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(first, len(ids)))[:, None]
    return np.add.reduceat(table[ids], first, axis=0) / np.sqrt(n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 11, kind=np.float32):
        rng = np.random.default_rng(seed)
        d = 3 * EMB
        init = lambda *s, k=1.0: (rng.normal(size=s) * k / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(kind)
        self.p = {
            "emb": (rng.normal(size=(3, BUCKETS, EMB)) * 0.05).astype(kind),
            "win": init(2, d, 3 * HID), "bin": np.zeros((2, 1, 3 * HID), kind), "u": init(2, HID, 3 * HID),
            "a": init(2 * HID, ATT), "ab": np.zeros(ATT, kind), "v": init(ATT, 1)[:, 0], "w": init(2 * HID, 1)[:, 0], "b": np.zeros(1, kind),
        }

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Input projections of both directions per word, one row of 6 * HID."""
        if len(words) > 8192:  # bounds the n-grams held at once
            out = np.empty((len(words), 6 * HID), self.p["win"].dtype)
            for a in range(0, len(words), 8192):
                out[a : a + 8192] = self.word_rows(words[a : a + 8192])
            return out
        x = np.concatenate([_sums(self.p["emb"][k], *io) for k, io in enumerate(inputs_of(words))], 1)
        return np.concatenate([x @ self.p["win"][d] + self.p["bin"][d] for d in range(2)], 1)

    def states(self, xp: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Hidden states [2,B,T,HID] from projections [2,B,T,3*HID]; masked words leave them as they are."""
        _, n, t, _ = xp.shape
        h = np.zeros((2, n, HID), xp.dtype)
        out = np.empty((2, n, t, HID), xp.dtype)
        saved = []
        for s in range(t):
            at = (s, t - 1 - s)
            x = np.stack([xp[0, :, at[0]], xp[1, :, at[1]]])
            m = np.stack([mask[:, at[0]], mask[:, at[1]]])[:, :, None]
            hu = h @ self.p["u"]
            zr = sigmoid(x[..., : 2 * HID] + hu[..., : 2 * HID])
            z, r = zr[..., :HID], zr[..., HID:]
            c = np.tanh(x[..., 2 * HID :] + r * hu[..., 2 * HID :])
            if keep:
                saved.append((h, z, r, c, hu[..., 2 * HID :], m))
            h = np.where(m, z * h + (1 - z) * c, h)
            out[0, :, at[0]], out[1, :, at[1]] = h[0], h[1]
        return out, saved

    def pool(self, states: np.ndarray, mask: np.ndarray):
        hs = np.concatenate([states[0], states[1]], 2)
        g = np.tanh(hs @ self.p["a"] + self.p["ab"])
        s = np.where(mask, g @ self.p["v"], -1e4)
        s = np.exp(s - s.max(1, keepdims=True)) * np.maximum(mask, 1e-9)
        alpha = s / s.sum(1, keepdims=True)
        c = (alpha[:, :, None] * hs).sum(1) * mask.any(1)[:, None]
        return c @ self.p["w"] + self.p["b"][0], (hs, g, alpha, c)

    def logits(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Window logits; ``rows`` from word_rows, ``at`` [B,T] row of each word."""
        xp = rows[at].reshape(*at.shape, 2, 3 * HID).transpose(2, 0, 1, 3)
        return self.pool(self.states(xp, mask)[0], mask)[0]

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Weighted log loss of windows over ``words`` and the gradient of every parameter."""
        p = self.p
        ins = inputs_of(words)
        x = np.concatenate([_sums(p["emb"][k], *io) for k, io in enumerate(ins)], 1)
        xs = x[at]
        xp = np.stack([xs @ p["win"][d] + p["bin"][d] for d in range(2)])
        st, saved = self.states(xp, mask, keep=True)
        logit, (hs, g, alpha, c) = self.pool(st, mask)
        prob = sigmoid(logit)
        loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum()
        dl = (weight * (prob - y) / weight.sum()).astype(x.dtype)
        grad = {"w": c.T @ dl, "b": dl.sum(keepdims=True)}
        dc = dl[:, None] * p["w"] * mask.any(1)[:, None]
        dalpha = (hs * dc[:, None]).sum(2)
        dhs = alpha[:, :, None] * dc[:, None]
        ds = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        grad["v"] = (g * ds[:, :, None]).sum((0, 1))
        dg = ds[:, :, None] * p["v"] * (1 - g**2)
        grad["a"] = np.tensordot(hs, dg, ([0, 1], [0, 1]))
        grad["ab"] = dg.sum((0, 1))
        dhs = dhs + dg @ p["a"].T
        dst = np.stack([dhs[..., :HID], dhs[..., HID:]])
        dxp = np.zeros_like(xp)
        du = np.zeros_like(p["u"])
        dh = np.zeros((2, len(y), HID), x.dtype)
        t = at.shape[1]
        for s in range(t - 1, -1, -1):
            h, z, r, cand, hn, m = saved[s]
            dh = dh + np.stack([dst[0, :, s], dst[1, :, t - 1 - s]])
            live = dh * m
            dz = live * (h - cand) * z * (1 - z)
            dn = live * (1 - z) * (1 - cand**2)
            dr = dn * hn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 2)
            dhu = np.concatenate([dz, dr, dn * r], 2)
            du += h.transpose(0, 2, 1) @ dhu
            dxp[0, :, s], dxp[1, :, t - 1 - s] = dx[0], dx[1]
            dh = dh * (1 - m) + live * z + dhu @ p["u"].transpose(0, 2, 1)
        grad["u"] = du
        grad["bin"] = dxp.sum((1, 2))[:, None]
        grad["win"] = np.stack([np.tensordot(xs, dxp[d], ([0, 1], [0, 1])) for d in range(2)])
        dxs = sum(dxp[d] @ p["win"][d].T for d in range(2)).reshape(-1, 3 * EMB)
        dword = np.stack([np.bincount(at.ravel(), dxs[:, k], len(words)) for k in range(3 * EMB)], 1)
        demb = np.zeros_like(p["emb"])
        for k, (ids, first) in enumerate(ins):
            n = np.diff(np.append(first, len(ids)))
            per = np.repeat(dword[:, k * EMB : (k + 1) * EMB] / np.sqrt(n)[:, None], n, axis=0)
            for j in range(EMB):
                demb[k, :, j] = np.bincount(ids, per[:, j], BUCKETS)
        grad["emb"] = demb
        return float(loss), grad

    def step(self, grad: dict, rate: float) -> None:
        """One Adagrad step."""
        if not hasattr(self, "seen"):
            self.seen = {k: np.full(v.shape, 1e-6, v.dtype) for k, v in self.p.items()}
        for k, g in grad.items():
            self.seen[k] += (g**2).astype(self.p[k].dtype)
            self.p[k] -= (rate * g / np.sqrt(self.seen[k])).astype(self.p[k].dtype)
