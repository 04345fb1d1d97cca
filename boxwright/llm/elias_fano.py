"""Elias-Fano sequences and the two-level n-gram trie made of them.

A sequence of n sorted integers below u keeps the low bits of each as they are
and the high parts as a bit vector of n ones and u >> low zeros: about
2 + log2(u / n) bits an element. Levels live in anonymous memory maps.
"""

from __future__ import annotations

import mmap

import numpy as np

_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.uint8)
#: Place of the r-th set bit of a byte.
_SELECT = np.array([(np.flatnonzero(row).tolist() + [8] * 8)[:8] for row in _BITS], np.int64)
_COUNT = _BITS.sum(1).astype(np.int64)


def mapped(data: np.ndarray) -> np.ndarray:
    """The array in a memory map of its own."""
    if not data.nbytes:
        return data
    area = mmap.mmap(-1, data.nbytes)
    out = np.frombuffer(area, data.dtype)
    out[:] = data.ravel()
    return out


class EliasFano:
    """Sorted unsigned integers, with random access and vectorised successor search."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.low_bits = max(0, min(56, (universe // max(1, self.n)).bit_length() - 1))
        width = self.low_bits
        packed = [np.zeros(0, np.uint8)]
        for i in range(0, self.n, 1 << 15):  # a multiple of 8, so that blocks end at a byte
            some = np.ascontiguousarray(values[i : i + (1 << 15)])
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width) if width else np.zeros((0, 0), np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        self.low = mapped(np.concatenate([*packed, np.zeros(8, np.uint8)]))
        high = (values >> np.uint64(width)).astype(np.int64)
        self.highs = (universe >> width) + 1
        size = -(-(self.n + self.highs + 1) // 64) * 64
        marks = np.zeros(size, np.uint8)
        marks[high + np.arange(self.n)] = 1
        self.high = mapped(np.packbits(marks, bitorder="little"))
        ones = _COUNT[self.high].reshape(-1, 8).sum(1)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)])
        self.zeros_before = mapped(zeros.astype(np.int64))
        self.ones_before = mapped(np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.zeros_before.nbytes + self.ones_before.nbytes

    def _select(self, r: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of the r-th one of the high bits, or of their r-th zero if ``flip`` is 255."""
        word = np.searchsorted(before, r, "right") - 1
        left = r - before[word]
        bits = self.high.reshape(-1, 8)[word] ^ np.uint8(flip)
        upto = np.cumsum(_COUNT[bits], axis=1)
        byte = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(r))
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[bits[rows, byte], left]

    def _select0(self, r: np.ndarray) -> np.ndarray:
        return self._select(r, self.zeros_before, 255)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, self.ones_before, 0) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        wide = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return wide[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x: index of the first element not below it, and whether it equals x.

        The high part leads to its run of elements by two selects; within the run
        the low parts are searched by halves.
        """
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = h < self.highs
        h = np.minimum(h, self.highs - 1)
        i = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        end = self._select0(h) - h
        want = x & np.uint64((1 << self.low_bits) - 1)
        begin, end = np.where(inside, i, self.n), np.where(inside, end, self.n)
        top = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # halves the runs that are still open
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < want[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        found = np.zeros(len(x), bool)
        some = np.flatnonzero(begin < top)
        found[some] = self._low(begin[some]) == want[some]
        return begin, found


#: Counts up to here have a code of their own; above, codes grow by about 5 %. Codes go past
#: every 64-bit count; the one code that stands for none is left out of them.
EXACT, GROWTH, NONE, CODES = 128, 1.05, 255, 1024


def quantised(counts: np.ndarray) -> np.ndarray:
    """A 16-bit code for each count from 1 on. Only counts over 62,000 need the upper byte."""
    c = np.maximum(counts.astype(np.float64), 1)
    over = EXACT - 1 + np.rint(np.log(np.maximum(c / EXACT, 1)) / np.log(GROWTH))
    code = np.where(c <= EXACT, c - 1, over)
    return (code + (code >= NONE)).astype(np.uint16)


def dequantised() -> np.ndarray:
    """Count for each code; none is 0."""
    code = np.arange(CODES, dtype=np.float64)
    code -= code > NONE
    out = np.where(code < EXACT, code + 1, EXACT * GROWTH ** (code - EXACT + 1))
    out[NONE] = 0
    return out


class Trie:
    """Contexts and their followers.

    Level 1 has the contexts (40-bit hashes) and where each one's followers begin,
    both Elias-Fano sequences. Level 2 has the followers (32-bit hashes) of all
    contexts in one sequence, each counted from its context's place on, which
    makes it monotone; with each goes a code for its count.
    """

    CONTEXT_BITS, FOLLOWER_BITS = 40, 32

    def __init__(self, context: np.ndarray, follower: np.ndarray, count: np.ndarray):
        """Parallel arrays, sorted by context and follower, each pair once."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        contexts = context[first]
        self.contexts = EliasFano(contexts, 1 << self.CONTEXT_BITS)
        self.pointers = EliasFano(np.concatenate([first, [len(context)]]), len(context) + 1)
        place = np.cumsum(np.isin(np.arange(len(context)), first)) - 1 if len(context) else np.zeros(0, np.int64)
        self.followers = EliasFano(place.astype(np.uint64) << np.uint64(self.FOLLOWER_BITS) | follower, max(1, len(contexts)) << self.FOLLOWER_BITS)
        self.codes = mapped(quantised(count))

    def find(self, context: np.ndarray, of: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Followers in total of each context; the code of each follower, ``of`` being its context's index."""
        if not self.contexts.n:
            return np.zeros(len(context), np.int64), np.full(len(of), NONE, np.uint16)
        i, known = self.contexts.successor(context)
        i = np.where(known, i, 0)
        total = np.where(known, (self.pointers.get(i + 1) - self.pointers.get(i)).astype(np.int64), 0)
        codes = np.full(len(of), NONE, np.uint16)
        ask = np.flatnonzero(known[of])
        at, found = self.followers.successor(i[of[ask]].astype(np.uint64) << np.uint64(self.FOLLOWER_BITS) | follower[ask])
        codes[ask[found]] = self.codes[at[found]]
        return total, codes
