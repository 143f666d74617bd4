"""A compressed full-text index over integer sequences: BWT in a wavelet matrix, searched backwards.

Kept are one bit per symbol and level with one count per 64 bits, the first row of each
symbol, and every ``SAMPLED``-th text place: other places are found by stepping back to
the next sampled one.  Neither the text nor its suffix array is kept.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SAMPLED = 8


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes (of the text read in a circle) that begin there.

    By prefix doubling from runs of ``step`` symbols that fit one number; a round sorts
    only what the rounds before left tied.
    """
    _, rank = np.unique(codes, return_inverse=True)
    n, bits = len(codes), max(1, int(rank.max()).bit_length()) if len(codes) else 1
    step = max(1, 62 // bits)
    key = rank.astype(np.int64)
    for k in range(1, step):
        key = key << bits | np.roll(rank, -k)
    order = np.argsort(key, kind="stable")
    at = np.arange(n)
    begins = np.ones(n, bool)
    begins[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, at, 0))
    while step < 2 * n:
        tied = np.flatnonzero(~(begins & np.append(begins[1:], True)))
        if not len(tied):
            break
        some = order[tied]
        key = rank[some] * n + rank[(some + step) % n]
        sort = np.argsort(key, kind="stable")
        some, key = some[sort], key[sort]
        order[tied] = some
        begins[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(begins[tied], tied, 0))
        step *= 2
    return order


class Bits:
    """A bit array with rank."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        at = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.counts[at] + np.bitwise_count(self.words[at] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64) & U64(1)).astype(bool)


class WaveletMatrix:
    """Symbols as levels of bits, the highest first, each level stably sorted by the ones above."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        values = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

        # Where the places of each symbol begin on the last level.
        self.first = np.zeros(sigma, np.int64)
        self.first = self._down(np.arange(sigma), self.first)

    def _down(self, symbol: np.ndarray, *places: np.ndarray) -> np.ndarray:
        """Places on the last level of each of the given ones, along the bits of a symbol; one row for each array."""
        i = np.concatenate(places)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            bit = np.tile(bit, len(places)) if len(places) > 1 else bit
            ones = self.bits[k].ones(i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return i.reshape(len(places), -1) if len(places) > 1 else i

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> np.ndarray:
        """How often a symbol stands before a place (one row for each array of places)."""
        return self._down(symbol, *places) - self.first[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        symbol = np.zeros_like(i)
        for k in range(self.levels):
            bit, ones = self.bits[k].get(i), self.bits[k].ones(i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i - self.first[symbol]


class FmIndex:
    """Index of ``codes``: symbols from 1; 0 separates texts."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        sigma = int(codes.max()) + 1 if self.n else 1
        places = suffix_order(codes)
        self.matrix = WaveletMatrix(codes[places - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        sampled = places % SAMPLED == 0
        self.marked, self.sample = Bits(sampled.astype(np.uint8)), (places[sampled] // SAMPLED).astype(np.int32)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, at_least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for each place before which a match ends.

        The length of the longest match of ``text`` ending there that the index holds
        ``at_least`` times, ``most`` at the most, and the rows of its occurrences.  All
        matches grow to the left together, a symbol at a time; one that would become
        rarer than asked for stops.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        alive = np.arange(len(ends))
        for k in range(1, most + 1):
            alive = alive[ends[alive] >= k]
            symbol = text[ends[alive] - k]
            if k == 1:
                a, b = self.before[symbol], self.before[symbol + 1]
            else:
                a, b = self.before[symbol] + self.matrix.rank(symbol, low[alive], high[alive])
            good = (b - a >= at_least) & (symbol > 0)
            alive = alive[good]
            if not len(alive):
                break
            low[alive], high[alive], length[alive] = a[good], b[good], k
        return length, low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Text places of index rows: steps to the left up to the next sampled place."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            here = self.marked.get(rows[todo])
            done = todo[here]
            out[done] = self.sample[self.marked.ones(rows[done])].astype(np.int64) * SAMPLED + steps[done]
            todo = todo[~here]
            symbol, before = self.matrix.at(rows[todo])
            rows[todo] = self.before[symbol] + before
            steps[todo] += 1
        return out % self.n

    def first_places(self, low: np.ndarray, high: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """The least text place of each range of rows; equal ranges are looked up once, ``block`` rows or so at a time."""
        _, back, where = np.unique(low * (self.n + 1) + high, return_index=True, return_inverse=True)
        own, sizes = low[back], high[back] - low[back]
        least = np.empty(len(own), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            size = sizes[at:to]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            rows = np.repeat(own[at:to] - first, size) + np.arange(int(size.sum()))
            least[at:to] = np.minimum.reduceat(self.places(rows), first)
            at = to
        return least[where]
