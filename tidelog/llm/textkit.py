"""Vectorised text kernels: white-space words, word hashes, shingles and substring hashes over a slice of documents."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
_COEF = _rng.integers(0, 2**64, 64, dtype=U) | U(1)
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation: what parts words for a classifier.
PUNCT = _SPACE.copy()
PUNCT[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    t = _tables.get(base)
    if t is None or len(t) <= n:
        size = 1 << max(16, int(n).bit_length())
        t = np.ones(size, U)
        t[1:] = U(base)
        np.multiply.accumulate(t, out=t)
        _tables[base] = t
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes, 0 first."""
    h = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _powers(_P, len(data))[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they lie."""
    inv = _powers(_INV, len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U) * _COEF[63])


def words(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE, stems: tuple[int, ...] = ()):
    """Lower-cased (A-Z) words of each document: (hashes, starts, ends, first word of each document and the total).

    For every length in stems, an array of the hashes of the words' first so many bytes follows.
    """
    low = _LOWER[data]
    inside = ~apart[low]
    n = len(low)
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    edge = offs[(offs > 0) & (offs < n)]
    prev[edge] = False
    starts = np.flatnonzero(inside & ~prev)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    stop[edge - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    h = prefix_hash(low)
    stems = [span_hash(h, starts, np.minimum(starts + k, ends)) for k in stems]
    return span_hash(h, starts, ends), starts, ends, np.searchsorted(starts, offs), *stems


def ngram_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k successive word hashes (document borders are the caller's to respect)."""
    m = len(w) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    s = np.full(m, k, U) * _COEF[62]
    for j in range(k):
        s += w[j : j + m] * _COEF[j % 60]
    return mix(s)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int):
    """For each document its sorted distinct k-word shingle hashes; a shorter text's whole sequence is one shingle."""
    w, _, _, first = words(data, offs)
    h = ngram_hash(w, k)
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            yield ngram_hash(w[a:b], b - a)
        else:
            yield np.zeros(0, U)
