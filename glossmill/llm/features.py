"""Counts and hashes of words and byte n-grams over batches of texts, and a sparse logistic model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, CHUNK + 8)
        _power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _M)], dtype=np.uint64)
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(pow(int(_M), -1, 1 << 64)))], dtype=np.uint64)
    return _power, _inverse


def prefix_sums(part: np.ndarray) -> np.ndarray:
    p, _ = powers(len(part) + 1)
    out = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges a:b, wherever they lie."""
    h = (sums[b] - sums[a]) * _inverse[a]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + (b - a).astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def spans(inside: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of ``inside``, cut at the texts' bounds."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = hi > lo
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[lo[full]] = False
    after[hi[full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def chunks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, lo, hi): neighbouring texts together; longer ones cut after white space.

    A text that is cut has several parts: what is counted must be added up over its rows.  A run of
    more than ``limit`` bytes without white space is cut within.
    """
    from .common import runs

    for i, j in runs(starts, ends, limit):
        if j - i > 1 or ends[i] - starts[i] <= limit:
            yield raw[starts[i] : ends[j - 1]], np.arange(i, j), starts[i:j] - starts[i], ends[i:j] - starts[i]
            continue
        at, end = int(starts[i]), int(ends[i])
        while at < end:
            to = min(at + limit, end)
            if to < end:
                back = np.flatnonzero(GAP[raw[max(at, to - 65536) : to]])
                to = max(at, to - 65536) + int(back[-1]) + 1 if len(back) else to
            yield raw[at:to], np.array([i]), np.array([0]), np.array([to - at])
            at = to


def sums_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values over lo:hi."""
    c = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=c[1:])
    return c[np.maximum(hi, lo)] - c[lo]


def grams(part: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed byte n-grams, one for each position at which one begins."""
    m = len(part) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = part[:m].astype(np.uint32)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) + part[k : k + m]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, dim: int, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 80, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sparse rows; y may be soft.  Adam on the whole sample."""
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    total = weight.sum() or 1.0
    mean = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)
    w, b = np.zeros(dim), float(np.log(mean / (1 - mean)))
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=vals * w[cols], minlength=n) + b
        g = weight * (sigmoid(z) - y) / total
        grad = np.bincount(cols, weights=vals * g[rows], minlength=dim) + l2 * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the last coefficient is the bias."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.ones(len(y)) if weight is None else weight
    n = weight.sum() or 1.0
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) / n + reg * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / n + np.diag(reg)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])
