"""Vectorized 64-bit hashing of words and shingles on numpy arrays; the same values on every machine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: a bijection that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) mod 2^64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, U)
        have[0], k = 1, 1
        while k < size:
            have[k : 2 * k] = have[:k] * U(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


BYTES = stream(7, 256)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_hashes(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """H with H[j] - H[i] = sum over k in i..j-1 of table[data[k]] BASE^k, mod 2^64."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of data[start:end], the same wherever the span lies."""
    n = int(end.max()) + 1 if len(end) else 1
    return (h[end] - h[start]) * powers(INVERSE, n)[start]


#: Little-endian bytes that count in a lane of so many of a word's bytes.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the text each belongs to. Words: no ASCII white space.

    A word goes through the mixer eight bytes at a time, so no linear relation of its bytes carries over to its hash.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(raw) + b"\n" + bytes(8)
    data = np.frombuffer(joined, np.uint8)[:-8]
    inside = np.concatenate(([False], ~SPACE[data]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U), np.empty(0, np.int64)
    lanes = np.ndarray((len(data),), "<u8", joined, strides=(1,))  # eight bytes from every place
    size = ends - starts
    h = mix(size.astype(U) * U(BASE))
    left = np.arange(len(starts))
    at = 0
    while len(left):
        h[left] = mix(h[left] ^ mix((lanes[starts[left] + at] & LANE[np.minimum(size[left] - at, 8)]) + U(0x9E3779B97F4A7C15)))
        at += 8
        left = left[size[left] > at]
    limits = np.cumsum([len(r) + 1 for r in raw])
    return h, np.searchsorted(limits, starts, "right")


def shingle_sets(texts: Sequence[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of all its words where there are fewer; none without words."""
    h, of = word_hashes(texts)
    n = len(h)
    count = np.bincount(of, minlength=len(texts))
    start = np.cumsum(count) - count
    factor = stream(11, k)
    full = max(0, n - k + 1)
    s = np.zeros(full, U)
    for j in range(k):
        s += h[j : j + full] * factor[j]
    s = mix(s)
    out = []
    for a, c in zip(start.tolist(), count.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            out.append(mix((h[a : a + c] * factor[:c]).sum(keepdims=True) + U(c)))
        else:
            out.append(np.empty(0, U))
    return out
