"""Byte-level kernels: words, word hashes and shingles of one text as numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLOCK = 4 << 20
_POW_BITS = 16

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POW = np.cumprod(np.full(1 << _POW_BITS, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def as_bytes(text: str | bytes | None) -> np.ndarray:
    if text is None:
        return np.empty(0, np.uint8)
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of [^\\x20\\x09-\\x0D]."""
    edge = np.ones(len(buf) + 2, bool)
    edge[1:-1] = SEPARATOR[buf]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    return turn[0::2], turn[1::2]


def _hash_block(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
    chars = buf[np.repeat(starts, lens) + inside]
    terms = _BYTE[chars] * _POW[inside & ((1 << _POW_BITS) - 1)]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in order. Works in blocks of words, so memory stays bounded for very long texts."""
    starts, ends = word_bounds(buf)
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(buf) <= _BLOCK:
        return _hash_block(buf, starts, ends)
    cut = np.searchsorted(ends, np.arange(_BLOCK, len(buf) + _BLOCK, _BLOCK))
    cut = np.unique(np.concatenate(([0], cut, [len(starts)])))
    return np.concatenate([_hash_block(buf, starts[a:b], ends[a:b]) for a, b in zip(cut[:-1], cut[1:])])


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * U(0x9FB21C651E98DF25) + words[j : n + j]
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words the whole sequence as one; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    h = windows(words, k) if len(words) >= k else mix(windows(words, len(words)) + U(len(words)))
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
