"""Vectorised words and hashes over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` (all six are ASCII,
so UTF-8 bytes can be scanned directly).  A sequence is hashed as a polynomial in
an odd base modulo 2**64 over random byte (or word) values, then mixed; ranges are
differences of prefix sums, so any window of words costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACES = bytes([32, 9, 10, 11, 12, 13])
#: Documents are taken in runs of about so many bytes, which bounds the work arrays.
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C13
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (splitmix64's finaliser)."""
    x = np.asarray(x).astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any range of ``values``."""
    up, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges of values get equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start])


class Words:
    """The words of a run of documents: byte bounds, hashes, and the first word of each document."""

    __slots__ = ("bounds", "data", "end", "hash", "rows", "start", "sums")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: range, fold: bool, space: np.ndarray | None = None, alone: np.ndarray | None = None):
        """``space``: the bytes that are no part of words; ``alone``: bytes at which a word ends and another begins."""
        self.data, self.rows = data, rows
        space = _IS_SPACE[data] if space is None else space
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = space[:-1]
        begins[offsets] = True
        if alone is not None:
            begins[alone] = True
        word = ~space
        self.start = np.flatnonzero(word & begins[:-1])
        stops = np.ones(len(data) + 1, bool)
        stops[:-1] = space
        stops[offsets] = True
        if alone is not None:
            stops[alone] = True
        self.end = np.flatnonzero(word & stops[1:]) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.sums = prefix((_FOLDED if fold else _BYTE)[data])
        self.hash = span(self.sums, self.start, self.end)


def binary_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """Runs of whole documents of about ``size`` bytes (a longer document is a run of its own)."""
    data, offsets = binary_column(col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], range(at, to)
        at = to


def words(col: pa.Array, fold: bool = False) -> Iterator[Words]:
    """Words of every document of a column, run by run; ``fold`` lower-cases A-Z."""
    for data, offsets, rows in chunks(col):
        yield Words(data, offsets, rows, fold)
