"""Words of whole Arrow batches as NumPy arrays: no Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


def released(run: Callable) -> Callable:
    """run, a generator over a task's batches, that gives free memory back to the system at its end: Python workers live on from stage to stage."""

    @wraps(run)
    def task(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_powers: dict[int, np.ndarray] = {}


def _power(seed: int, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the seed's odd base."""
    have = _powers.get(seed)
    if have is None or len(have) < n:
        base = np.full(max(64, n), constants(1, seed)[0], np.uint64)
        base[0] = 1
        have = _powers[seed] = np.multiply.accumulate(base)
    return have


_byte_values = {s: constants(256, 1000 + s) for s in (0, 1)}


class Words:
    """Words of a slice of texts: byte places ``start``/``end`` in ``data``, and ``first``, where each text's words begin (with the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.at = at
        ink = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        if len(data):
            before[1:] = ink[:-1]
            before[at[:-1][at[:-1] < len(data)]] = False
            after = np.zeros(len(data), bool)
            after[:-1] = ink[1:]
            ends = at[1:]
            after[ends[ends > 0] - 1] = False
            self.start = np.flatnonzero(ink & ~before)
            self.end = np.flatnonzero(ink & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, at)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        byte = self.data[np.repeat(self.start, size) + place]
        terms = _byte_values[seed & 1][byte] * _power(seed, int(size.max()))[place]
        return mix(np.add.reduceat(terms, begin[:-1]) + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def prefix_hashes(self, n: int, seed: int = 0) -> np.ndarray:
        """A hash of each word's first n bytes; 0 for shorter words."""
        out = np.zeros(len(self.start), np.uint64)
        ok = self.end - self.start >= n
        at = self.start[ok]
        for k in range(n):
            out[ok] += _byte_values[seed & 1][self.data[at + k]] * _power(seed + 7, n)[k]
        out[ok] = mix(out[ok] + U(n + 1)) | U(1)
        return out


def roll(h: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """A hash of each run of n neighbours of h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c, out = constants(1, seed)[0], h[:m].copy()
    for k in range(1, n):
        out *= c
        out += h[k : k + m]
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and the places where values begin (with the end)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, values = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if places is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of about SLICE_BYTES each."""
    data, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, Words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        i = j
