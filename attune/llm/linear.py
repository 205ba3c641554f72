"""Linear text classifiers on hashed n-grams, with all loops over characters in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def grams(texts: list[str], sizes: tuple[int, ...], bits: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every character n-gram; texts are bounded by a mark on either side."""
    marked = [f"\x02{t}\x03" for t in texts]
    lengths = np.fromiter((len(m) for m in marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    rows, feats = [], []
    h = np.full(len(code), np.uint64(salt * 1000003 + 17))
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * _PRIME + code[n - 1 :]
            if n in sizes:
                whole = owner[: len(h)] == owner[n - 1 :]
                rows.append(owner[: len(h)][whole])
                feats.append((_mix(h[whole] ^ np.uint64(n)) & np.uint64((1 << bits) - 1)).astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(feats)


def distinct(rows: np.ndarray, feats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per text."""
    key = (rows << bits) | feats
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> bits, key & ((1 << bits) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(rows: np.ndarray, feats: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, weight: np.ndarray | None = None, l2: float = 1e-6, rounds: int = 8, rate: float = 0.5, parts: int = 24, seed: int = 1) -> np.ndarray:
    """Weights (size + 1, the last is the bias) of an L2-regularised logistic regression.

    Adagrad over ``parts`` batches a round, rows dealt to batches by ``seed``; batches of a round differ in order.
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12) * n
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, n // 8))
    batch = rng.permutation(n) % parts
    by = np.argsort(batch[rows], kind="stable")
    edge = np.searchsorted(batch[rows][by], np.arange(parts + 1))
    members = [np.flatnonzero(batch == k) for k in range(parts)]
    place = np.empty(n, np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    slices = [by[edge[k] : edge[k + 1]] for k in range(parts)]
    data = [(place[rows[i]], feats[i], values[i]) for i in slices]
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(rounds):
        for k in rng.permutation(parts):
            r, f, v = data[k]
            m = members[k]
            if not len(m):
                continue
            d = (sigmoid(np.bincount(r, w[f] * v, len(m)) + w[-1]) - y[m]) * weight[m] / len(m)
            g = np.append(np.bincount(f, d[r] * v, size), d.sum())
            g[:-1] += l2 * w[:-1]
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return w


@dataclass
class NaiveBayesLinear:
    """Logistic regression on n-gram presence scaled by naive Bayes log-count ratios, rows of unit length."""

    weights: np.ndarray  # ratio times coefficient, per feature
    bias: float
    ratio: np.ndarray  # squared ratios, for the row lengths
    sizes: tuple[int, ...]
    bits: int

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, weight: np.ndarray | None = None, sizes: tuple[int, ...] = (2, 3, 4, 5), bits: int = 20, alpha: float = 0.5, **how) -> NaiveBayesLinear:
        rows, feats = distinct(*grams(texts, sizes, bits), bits)
        size = 1 << bits
        mass = np.ones(len(y)) if weight is None else weight
        p = np.bincount(feats, (mass * y)[rows], size) + alpha
        q = np.bincount(feats, (mass * (1 - y))[rows], size) + alpha
        r = np.log((p / p.sum()) / (q / q.sum()))
        r[(p + q) < 2 * alpha + 1e-9] = 0  # unseen n-grams say nothing
        length = np.sqrt(np.maximum(np.bincount(rows, r[feats] ** 2, len(texts)), 1e-9))
        w = logistic(rows, feats, r[feats] / length[rows], y, size, weight, **how)
        return cls(w[:-1] * r, float(w[-1]), r**2, sizes, bits)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-odds of every text."""
        if not texts:
            return np.empty(0)
        rows, feats = distinct(*grams(texts, self.sizes, self.bits), self.bits)
        length = np.sqrt(np.maximum(np.bincount(rows, self.ratio[feats], len(texts)), 1e-9))
        return np.bincount(rows, self.weights[feats], len(texts)) / length + self.bias


def calibrate(score: np.ndarray, y: np.ndarray, tolerance: float = 0.005) -> float:
    """Threshold on held-out scores: the middle of the range whose F1 is within ``tolerance`` of the best."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    if not len(s) or hit[-1] == 0:
        return 0.0
    k = np.arange(1, len(s) + 1)
    f1 = 2 * hit / (k + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # a threshold cannot part equal scores
    good = np.flatnonzero(f1 >= f1.max() - tolerance)
    top, low = s[good[0]], s[good[-1] + 1] if good[-1] + 1 < len(s) else s[good[-1]] - 1e-6
    return float((top + low) / 2)
