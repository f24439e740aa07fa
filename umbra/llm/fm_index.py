"""A compressed FM-index over many short word sequences: matching statistics by backward search over a wavelet matrix.

What is kept of the sequences is their Burrows-Wheeler transform as packed bit rows, one
for each binary digit of a word's number, and bit rows that tell where neighbouring
suffixes part within a given number of words. Texts, suffix order and ranks are let go.
All work is done on whole arrays: all patterns take one step to the left at a time.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed row of bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Rank over a sequence of small integers: one row of bits for each binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, int(sigma - 1).bit_length())
        rest = symbols.astype(np.int64)
        for k in range(self.depth - 1, -1, -1):
            bit = (rest >> k & 1).astype(np.uint8)
            self.levels.append((Bits(bit), len(rest) - int(bit.sum())))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each symbol, how many of it lie before the place at, plus the symbol's own first place in the last row."""
        at = at.copy()
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.rank(at)
            at = np.where(symbols >> k & 1, zeros + ones, at - ones)
        return at


def _sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes in order (ends, which are zeros, differ by place), and each suffix's rank by its first 1, 2, 4 ... words."""
    n, ends = len(text), text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(ends.sum())
    _, rank = np.unique(rank, return_inverse=True)
    span, kept = 1, {1: rank}
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        span *= 2
        kept[span] = rank
        if n == 0 or (new[-1] == n - 1 and span >= depth):
            return order, kept


class FmIndex:
    """Index of word sequences (integers from 1), given end to end with a 0 after each.

    depth caps matching statistics. For every run of two or more suffixes that share their
    first depth words the index holds the smallest place.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        order, kept = _sorted_suffixes(text, depth)
        self.sigma = int(text.max()) + 1 if self.n else 1
        self.wavelet = Wavelet(text[order - 1], self.sigma)
        self.first = self.wavelet.rank(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))[:-1]
        shared = np.zeros(max(0, self.n - 1), np.int64)  # words that neighbouring suffixes share, up to twice the depth
        for span in sorted((s for s in kept if s <= depth), reverse=True):
            a, b = (np.minimum(x + shared, self.n - 1) for x in (order[:-1], order[1:]))
            shared += span * (kept[span][a] == kept[span][b])
        self.shared = np.minimum(np.concatenate(([0], shared)), depth).astype(np.uint8)[: self.n]
        self._parted: dict[int, tuple[Bits, np.ndarray]] = {}
        _, begin = self.parted(depth)
        wide = np.diff(begin) > 1
        self.wide = Bits(wide)
        self.earliest = np.minimum.reduceat(order, begin[:-1])[wide].astype(np.int32) if self.n else np.zeros(0, np.int32)

    def parted(self, words: int) -> tuple[Bits, np.ndarray]:
        """Where a suffix differs from the one before within so many words: as bits, and as places with the end."""
        if words not in self._parted:
            new = self.shared < words
            self._parted[words] = Bits(new), np.append(np.flatnonzero(new), self.n).astype(np.int32)
        return self._parted[words]

    def widened(self, low: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of all suffixes that share so many words with the one at low, and its number."""
        bits, begin = self.parted(words)
        k = bits.rank(low + 1) - 1
        return begin[k].astype(np.int64), begin[k + 1].astype(np.int64), k

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with a symbol and go on as those of [low, high)."""
        base = self.smaller[symbols] - self.first[symbols]
        return base + self.wavelet.rank(symbols, low), base + self.wavelet.rank(symbols, high)

    def count(self, pattern: np.ndarray) -> int:
        low, high = np.array([0]), np.array([self.n])
        for w in pattern[::-1]:
            low, high = self.step(np.array([w]), low, high)
        return max(0, int(high[0] - low[0]))

    def statistics(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns words[start:end), streamed from right to left, at every place.

        (length, low, high): how many words from a place on occur in the index (depth at most,
        and not beyond the pattern's end), and the interval of their occurrences. Words that
        the index doesn't know are 0. A match that can't be extended gives up words at its
        right end until it can.
        """
        length, lows, highs = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        low, high, size = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        at, live = ends - 1, np.arange(len(starts))
        while len(live := live[at[live] >= starts[live]]):
            here = words[at[live]]
            left = live[(here > 0) & (here < self.sigma)]
            lost = live[(here <= 0) | (here >= self.sigma)]
            low[lost], high[lost], size[lost] = 0, self.n, 0
            while len(left):
                a, b = self.step(words[at[left]], low[left], high[left])
                met = a < b
                done, over = left[met], left[~met & (size[left] == 0)]
                low[done], high[done] = a[met], b[met]
                size[done] += 1
                low[over], high[over] = 0, self.n
                left = left[~met & (size[left] > 0)]
                size[left] -= 1
                for words_left in np.unique(size[left]):
                    some = left[size[left] == words_left]
                    low[some], high[some] = self.widened(low[some], int(words_left))[:2] if words_left else (0, self.n)
            deep = live[size[live] > self.depth]
            low[deep], high[deep], _ = self.widened(low[deep], self.depth)
            size[deep] = self.depth
            length[at[live]], lows[at[live]], highs[at[live]] = size[live], low[live], high[live]
            at[live] -= 1
        return length, lows, highs

    def first_place(self, low: np.ndarray) -> np.ndarray:
        """The smallest place among two or more suffixes that share depth words; low: any of them."""
        return self.earliest[self.wide.rank(self.widened(low, self.depth)[2])]
