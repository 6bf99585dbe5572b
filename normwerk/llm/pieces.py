"""Pieces of text as arrays: code points, 128-bit keys of stretches of them, and a table of the keys that are known.

What is said about a distinct piece (its token ids, its class) is worked out once per worker; every other occurrence is found
in the table, for all pieces of a stretch of text together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are worked on together: arrays of this length stay in a core's cache.
CHUNK = 1 << 18
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2^64
_values: list[np.ndarray] = []
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def chunks(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Stretches of about CHUNK characters: their texts and the numbers of these.

    A text of more is cut where words of ASCII letters meet, so it comes in several stretches and then as a text of its own in each.
    """
    some: list[str] = []
    of: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while len(t) - at > 2 * CHUNK and (m := _CUT.search(t, at + CHUNK)):
            if some:
                yield some, of
                some, of, size = [], [], 0
            yield [t[at : m.start()]], [i]
            at = m.start()
        some.append(t[at:] if at else t)
        of.append(i)
        size += len(some[-1])
        if size >= CHUNK:
            yield some, of
            some, of, size = [], [], 0
    if some:
        yield some, of


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in `column` have about `size` bytes, so that what is made of them stays small too."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // size, append=-1)) + 1 if len(n) else []
    first = 0
    for last in np.asarray(ends).tolist():
        yield batch.slice(first, last - first)
        first = last


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class ByCodePoint:
    """kind(character) (under 255) for arrays of code points; a character is looked at when it first occurs."""

    def __init__(self, kind: Callable[[str], int]):
        self.kind, self.table = kind, np.full(0x110000, 255, dtype=np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if len(out) and out.max() == 255:
            for x in np.unique(points[out == 255]).tolist():
                self.table[x] = self.kind(chr(x))
            out = self.table[points]
        return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _tables(n: int) -> None:
    if not _values:
        _values.append(np.random.default_rng(2).integers(0, 2**63, 0x110000, dtype=np.uint64))
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, CHUNK * 2)
        _powers[:] = [(_powers_of(b, size), _powers_of(pow(b, -1, 1 << 64), size)) for b in _BASES]


def sums(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: int = 1) -> list[np.ndarray]:
    """Hashes of each stretch of 64-bit values: sums of the values times powers of a base, modulo 2^64."""
    _tables(len(value) + 1)
    n, out = (ends - starts).astype(np.uint64), []
    for power, inverse in _powers[:bases]:
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value * power[: len(value)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts] + n
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASES[0])
        out.append(h ^ (h >> np.uint64(29)))
    return out


def keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each stretch of code points."""
    _tables(0)
    return sums(_values[0][points], starts, ends, 2)


class Table:
    """Numbers, from 0, of distinct keys in the order in which they were added; open addressing, at most half full."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.h, self.g = (np.zeros(1 << bits, dtype=np.uint64) for _ in range(2))
        self.number = np.full(1 << bits, -1, dtype=np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(h)
        out = self.number[slot]
        other = (out >= 0) & ((self.h[slot] != h) | (self.g[slot] != g))
        todo = np.flatnonzero(other)
        while len(todo):
            slot[todo] = at = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = n = self.number[at]
            todo = todo[(n >= 0) & ((self.h[at] != h[todo]) | (self.g[at] != g[todo]))]
        return out

    def _put(self, h: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        slot = self._slot(h)
        while len(h):
            free = self.number[slot] < 0
            self.number[slot[free]] = n[free]  # of those that meet, the last stays
            won = self.number[slot] == n
            self.h[slot[won]], self.g[slot[won]] = h[won], g[won]
            h, g, n, slot = h[~won], g[~won], n[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        """Distinct keys that aren't there yet; they get the next numbers."""
        if 2 * (self.count + len(h)) > 1 << self.bits:
            at = np.flatnonzero(self.number >= 0)
            old = self.h[at], self.g[at], self.number[at]
            self._room(max(self.bits + 1, int(2 * (self.count + len(h))).bit_length()))
            self._put(*old)
        self._put(h, g, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)


class Rows:
    """Lists of integers, one after another, in arrays that grow."""

    def __init__(self):
        self.flat, self.start = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64)
        self.count = 0  # start[count] is the end of the last

    def extend(self, lengths: list[int], values: list[int]) -> None:
        first = int(self.start[self.count])
        while len(self.flat) < first + len(values):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) <= self.count + len(lengths):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[first : first + len(values)] = values
        self.start[self.count + 1 : self.count + 1 + len(lengths)] = first + np.cumsum(np.array(lengths, dtype=np.int64))
        self.count += len(lengths)

    def truncate(self, count: int) -> None:
        self.count = count

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' integers, joined, and where each begins (with the end of the last)."""
        first = self.start[numbers]
        n = self.start[numbers + 1] - first
        bounds = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])], bounds
