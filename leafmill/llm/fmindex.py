"""An FM-index over strings of numbered words: backward search by the ranks of a wavelet matrix, places by sampled suffixes."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector with ranks: 64 bits and one count to a word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(_U)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int64)
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w, r = i >> 6, (i & 63).astype(_U)
        return self.before[w] + np.bitwise_count(self.words[w] & ((_U(1) << r) - _U(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U) & _U(1)).astype(bool)


class Wavelet:
    """Symbols by their bits from the highest on, each level dealt stably by the bit above it."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            b = Bits(one)
            self.levels.append((shift, b, len(symbols) - b.ones))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        every = np.arange(1 << depth)
        self.base = self._down(every, np.zeros_like(every))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i."""
        return self._down(symbol, i) - self.base[symbol]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return symbol, i - self.base[symbol]


def suffix_order(symbols: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """All suffixes in order, by doubled prefixes; left: symbols to the end of the string. Equal strings stand in their own order."""
    n, pack = len(symbols), max(1, 62 // bits)
    padded = np.append(symbols, np.zeros(pack, symbols.dtype)).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(pack):
        key = key << bits | np.where(left >= j, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = left[order] < pack  # a string that ends within the key differs from all others
    fresh[1:] |= k[1:] != k[:-1]
    fresh[:1] = True
    rank, reach = np.empty(n, np.int64), pack
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos = order[at]
        group, ahead = rank[pos], rank[pos + reach]
        by = np.lexsort((ahead, group))
        order[at] = pos = pos[by]
        group, ahead = group[by], ahead[by]
        fresh[at[1:]] |= (ahead[1:] != ahead[:-1]) & (group[1:] == group[:-1])
        rank[pos] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        reach *= 2


class FmIndex:
    """symbols: strings of numbers from 1 on, each ended by a 0. A suffix's place is kept where it is a multiple of `every` or begins a string."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        n = len(symbols)
        depth = max(1, int(symbols.max(initial=0)).bit_length())
        ends = np.flatnonzero(symbols == 0)
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        order = suffix_order(symbols, left, depth)
        self.n, self.sigma = n, 1 << depth
        begins = np.zeros(n + 1, bool)
        begins[0] = True
        begins[ends + 1] = True
        before = np.where(begins[order], 0, symbols[order - 1])
        self.bwt = Wavelet(before.astype(np.int64), depth)
        self.smaller = np.append(0, np.cumsum(np.bincount(symbols, minlength=self.sigma)))
        sampled = begins[order] | (order % every == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases (its first `sizes` symbols) the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        if not self.n:
            return lo, lo.copy()
        alive = np.flatnonzero(sizes > 0)
        hi[sizes <= 0] = 0
        step = 0
        while len(alive):
            c = phrases[alive, sizes[alive] - 1 - step].astype(np.int64)
            there = c < self.sigma
            a, z = lo[alive], hi[alive]
            c = np.where(there, c, 0)
            a = self.smaller[c] + self.bwt.rank(c, a)
            z = np.where(there, self.smaller[c] + self.bwt.rank(c, z), a)
            lo[alive], hi[alive] = a, z
            step += 1
            alive = alive[(z > a) & (sizes[alive] > step)]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range's suffixes, the range's number and the place where the suffix begins."""
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), count)
        i = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
        place, steps, open_ = np.empty(len(i), np.int64), 0, np.arange(len(i))
        while len(open_):
            here = i[open_]
            known = self.sampled.get(here)
            place[open_[known]] = self.places[self.sampled.rank(here[known])] + steps
            open_ = open_[~known]
            symbol, before = self.bwt.read(here[~known])
            i[open_] = self.smaller[symbol] + before
            steps += 1
        return which, place
