"""Exact binomial bounds through the regularized incomplete beta function, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(Beta(a, b) <= x) for a, b > 0: Lentz's continued fraction on the side where it converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    v = front * f
    return np.clip(np.where(swap, 1 - v, v), 0, 1)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p quantile of Beta(a, b), by bisection."""
    a, b = (np.asarray(v, float) for v in np.broadcast_arrays(a, b))
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = beta_cdf(a, b, mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def upper_bound(k: np.ndarray, n: np.ndarray, level: float) -> np.ndarray:
    """Clopper-Pearson: the rate that k or fewer of n would have with probability level only; 1 where n is 0."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    certain = k >= n
    return np.where(certain, 1.0, beta_quantile(1 - level, np.where(certain, 1, k + 1), np.where(certain, 1, n - k)))
