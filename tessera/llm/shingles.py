"""Sets of word shingles as 64-bit hashes, made in numpy from the bytes of Arrow string columns.

A word is a run of bytes that aren't ASCII white space, with A-Z in lower case.  Its hash is a polynomial modulo 2**64
over random values of its bytes, taken from prefix sums; a shingle's hash mixes those of its words in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PIECE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit numbers."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Shingler:
    """``sets`` gives the sorted distinct shingles of texts."""

    def __init__(self, width: int = 5):
        self.width = width
        seeds = _mixed(np.arange(1, 600, dtype=_U) * _U(0x9E3779B97F4A7C15))
        values = seeds[:256].copy()
        values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.factors = seeds[256 : 256 + width] | _U(1)
        self.lengths = seeds[300 : 301 + width]
        base = int(seeds[400] | _U(1))
        inverse = pow(base, -1, 1 << 64)
        self._base, self._inverse = _U(base), _U(inverse)
        self._powers = self._inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, _PIECE + 1)
            for name, x in (("_powers", self._base), ("_inverses", self._inverse)):
                steps = np.full(n, x, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def words(self, data: np.ndarray) -> np.ndarray:
        """The hash of each word of one text."""
        pieces, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + _PIECE)
            if hi < len(data):
                at = np.flatnonzero(self.space[data[lo:hi]])
                while not len(at) and hi < len(data):
                    lo2, hi = hi, min(len(data), hi + _PIECE)
                    at = np.flatnonzero(self.space[data[lo2:hi]]) + (lo2 - lo)
                hi = lo + int(at[-1]) + 1 if len(at) else len(data)
            pieces.append(self._words(data[lo:hi], np.zeros(1, np.int64))[0])
            lo = hi
        return np.concatenate(pieces) if pieces else np.zeros(0, _U)

    def _words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and where it starts; ``starts``: where texts start."""
        ink = np.zeros(len(data) + 2, bool)
        np.logical_not(self.space[data], out=ink[1:-1])
        first = ink[1:-1] & ~ink[:-2]
        first[starts[starts < len(data)]] = ink[1:-1][starts[starts < len(data)]]
        last = ink[1:-1] & ~ink[2:]
        inner = starts[(starts > 0) & (starts < len(data))] - 1
        last[inner] = ink[1:-1][inner]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self._powers[: len(data)], out=sums[1:])
        return _mixed((sums[b] - sums[a]) * self._inverses[a]), a

    def _set(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n == 0:
            return words
        if n < self.width:
            return _mixed((words * self.factors[:n]).sum(dtype=_U, keepdims=True) + self.lengths[n])
        total = np.zeros(n - self.width + 1, _U)
        for k in range(self.width):
            total += words[k : n - self.width + 1 + k] * self.factors[k]
        return np.unique(_mixed(total))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text of a string column its shingles; null and texts without words have none."""
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        valid = np.ones(n, bool) if column.null_count == 0 else ~np.asarray(column.is_null())
        i = 0
        while i < n:
            j = i + 1
            while j < n and offsets[j + 1] - offsets[i] <= _PIECE:
                j += 1
            if offsets[j] - offsets[i] > _PIECE:
                hashes, bounds = self.words(data[offsets[i] : offsets[j]]), None
            else:
                local = offsets[i : j + 1] - offsets[i]
                hashes, at = self._words(data[offsets[i] : offsets[j]], local[:-1])
                bounds = np.searchsorted(at, local)
            for k in range(i, j):
                own = hashes if bounds is None else hashes[bounds[k - i] : bounds[k - i + 1]]
                yield self._set(own) if valid[k] else np.zeros(0, _U)
            i = j
