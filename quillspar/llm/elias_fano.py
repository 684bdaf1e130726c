"""Elias-Fano sequences with random access and search, over whole arrays of queries."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONE = U64(1)
#: Words of a block, before each of which the ones and the zeros are counted.
BLOCK = 8


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of a given rank in each word."""
    place = np.zeros(len(word), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        part = np.bitwise_count(word & U64((1 << step) - 1)).astype(np.int64)
        above = rank >= part
        rank = np.where(above, rank - part, rank)
        word = np.where(above, word >> U64(step), word)
        place += above * step
    return place


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary.

    Arrays may be memory-mapped; nothing is unpacked but what is asked for.
    """

    PARTS = ("shape", "low", "high", "ones", "zeros")

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.top = (int(x) for x in shape)
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        words = np.zeros(n * width // 64 + 2, U64)
        if width:
            low = values & U64((1 << width) - 1)
            at = np.arange(n, dtype=U64) * U64(width)
            word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            # at is ascending, so the parts of one word are a run
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[start]] = np.bitwise_or.reduceat(low << bit, start)
            over = bit + U64(width) > U64(64)
            words[word[over] + 1] |= low[over] >> (U64(64) - bit[over])
        ones = (values >> U64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(ones[-1]) if n else 0) // (64 * BLOCK) + 1) * 64 * BLOCK, bool)
        unary[ones] = True
        high = np.packbits(unary, bitorder="little").view(U64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, BLOCK).sum(1, dtype=np.int64))])
        return cls(np.array([n, width, top >> width]), words, high, before, np.arange(len(before)) * 64 * BLOCK - before)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.width, self.top]), "low": self.low, "high": self.high, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> EliasFano:
        return cls(*(np.asarray(arrays[k]) for k in cls.PARTS))  # plain views of what is mapped

    def _place(self, i: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Bits of the ones (or with all bits flipped the zeros) numbered i, by their counts before each block."""
        block = np.searchsorted(before, i, "right") - 1
        rank, at = i - before[block], block * BLOCK
        word = self.high[at] ^ flip
        count = np.bitwise_count(word).astype(np.int64)
        open_ = np.flatnonzero(rank >= count)
        while len(open_):
            rank[open_] -= count[open_]
            at[open_] += 1
            word[open_] = self.high[at[open_]] ^ flip
            count[open_] = np.bitwise_count(word[open_])
            open_ = open_[rank[open_] >= count[open_]]
        return at * 64 + _select(word, rank)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        i = np.asarray(i, np.int64)
        value = (self._place(i, self.ones, U64(0)) - i).astype(U64) << U64(self.width)
        return value | self._low(i) if self.width else value

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits = i.astype(U64) * U64(self.width)
        cell, bit = (bits >> U64(6)).astype(np.int64), bits & U64(63)
        low = self.low[cell] >> bit
        over = np.flatnonzero(bit + U64(self.width) > U64(64))
        low[over] |= self.low[cell[over] + 1] << (U64(64) - bit[over])
        return low & U64((1 << self.width) - 1)

    def _span(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first value with such high bits or more, and of the first with more: a zero and the next one."""
        first, last = np.where(high > self.top, self.n, 0), np.full(len(high), self.n, np.int64)
        some = np.flatnonzero((high > 0) & (high <= self.top))
        zero, begin = high[some] - 1, np.zeros(len(high), np.int64)
        place = self._place(zero, self.zeros, ~U64(0))
        first[some], begin[some] = place - zero, place + 1
        inner = np.flatnonzero(high < self.top)
        begin = begin[inner]
        at = begin >> 6
        word = ~self.high[at] & (~U64(0) << (begin & 63).astype(U64))
        open_ = np.flatnonzero(word == 0)
        while len(open_):
            at[open_] += 1
            word[open_] = ~self.high[at[open_]]
            open_ = open_[word[open_] == 0]
        last[inner] = at * 64 + np.bitwise_count((word & (~word + U64(1))) - U64(1)) - high[inner]
        return first, last

    def _search(self, begin: np.ndarray, end: np.ndarray, x: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First place in [begin, end) with a value of x or more, and the end of those that share x's high bits.

        The high bits lead to the few values that share them; those are searched by their low bits.
        If only x itself will do, one value alone is left to be compared.
        """
        part = np.minimum(x >> U64(self.width), U64(self.top + 1)).astype(np.int64)
        low, last = (np.clip(x, begin, end) for x in self._span(part))
        if not self.width:
            return low, last
        open_ = np.flatnonzero(low + exact < last)
        begin, end, want = low[open_], last[open_], x[open_] & U64((1 << self.width) - 1)
        while len(open_):
            middle = (begin + end) >> 1
            less = self._low(middle) < want
            begin, end = np.where(less, middle + 1, begin), np.where(less, end, middle)
            low[open_] = begin
            left = np.flatnonzero(begin < end)
            open_, begin, end, want = open_[left], begin[left], end[left], want[left]
        return low, last

    def successor(self, begin: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First place in [begin, end) with a value of x or more; end where there is none."""
        return self._search(np.asarray(begin, np.int64), np.asarray(end, np.int64), np.asarray(x, U64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, -1 where it isn't: the successor, if it is x itself."""
        order = np.argsort(x)  # neighbours share what they read
        x = np.asarray(x, U64)[order]
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
        asked, count = x[new], np.diff(np.append(new, len(x)))
        none = np.zeros(len(asked), np.int64)
        place, last = self._search(none, none + self.n, asked, exact=True)
        inside = np.flatnonzero(place < last)
        if self.width:
            inside = inside[self._low(place[inside]) == asked[inside] & U64((1 << self.width) - 1)]
        found = np.full(len(asked), -1, np.int64)
        found[inside] = place[inside]
        out = np.empty(len(x), np.int64)
        out[order] = np.repeat(found, count)
        return out
