"""Bulk look-up of the ids of text units: rolling hashes, an open-addressing table and ragged copies, all in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from . import _text as T

U = np.uint64
#: Symbols hashed in one go; the power tables are as long.
CHUNK = 1 << 20
#: Longer units do not rest on the rolling hash.
HASHED_UNIT = 256
_BASE = 0x9E3779B97F4A7C15
_POW = np.empty(0, np.uint64)
_INV = np.empty(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK)
        steps = np.full((2, size), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        _POW, _INV = np.cumprod(steps[0]), np.cumprod(steps[1])
    return _POW[:n], _INV[:n]


def unit_hashes(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A non-zero 64-bit hash of each unit; terms holds a random number per symbol and is overwritten."""
    power, inverse = _powers(len(terms) + 1)
    terms *= power[:-1]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    h = T.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return h | U(1)


def long_hash(unit: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(unit, digest_size=8).digest(), "little") | 1


def slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... counts[i] times, one unit after the other."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


class Lookup:
    """An open-addressing table from non-zero 64-bit keys to numbers, read and filled by whole arrays."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (keys & U(mask)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            held = self.keys[slot[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (held != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        while (self.size + len(keys)) * 2 > 1 << self.bits:
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.values[used]
            self.bits, self.size = self.bits + 1, 0
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(*old)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask, todo = (1 << self.bits) - 1, np.arange(len(keys))
        slot = (keys & U(mask)).astype(np.int64)
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of several that meet in a slot one stays
            mine = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[mine]]] = values[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & mask
        self.size += len(keys)


class IdTable:
    """Ids of known units. Holds at most about most units and most * 6 ids: some 50 MB at the default; then it starts anew."""

    def __init__(self, most: int = 700_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.lookup, self.units, self.used = Lookup(), 0, 0
        self.start, self.count = np.empty(1024, np.int32), np.empty(1024, np.int32)
        self.flat = np.empty(4096, np.uint32)

    def full(self, more: int) -> bool:
        return self.units + more > self.most or self.used > 6 * self.most

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        n, m = self.units + len(keys), self.used + len(ids)
        while n > len(self.start):
            self.start, self.count = (np.concatenate((a, np.empty_like(a))) for a in (self.start, self.count))
        while m > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.start[self.units : n] = self.used + np.cumsum(counts) - counts
        self.count[self.units : n] = counts
        self.flat[self.used : m] = ids
        self.lookup.put(keys, np.arange(self.units, n, dtype=np.int32))
        self.units, self.used = n, m

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after the other, and where each unit's ids end."""
        counts = self.count[entries].astype(np.int64)
        return self.flat[slices(self.start[entries].astype(np.int64), counts)], np.cumsum(counts)


def groups(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most most, or of one that is larger."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
