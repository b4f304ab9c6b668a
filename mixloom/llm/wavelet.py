"""An FM-index over whole-number sequences: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words that counts its ones before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """A sequence level by level, highest bit first, zeros of each level moved before its ones."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            bits = ((values >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum(dtype=np.int64))))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            is_one = ((symbols >> shift) & 1).astype(bool)
            ones_low, ones_high = bits.ones(low), bits.ones(high)
            low = np.where(is_one, zeros + ones_low, low - ones_low)
            high = np.where(is_one, zeros + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbols, low = np.zeros_like(at), np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            symbols |= one << shift
            ones_low, ones_at = bits.ones(low), bits.ones(at)
            low = np.where(one == 1, zeros + ones_low, low - ones_low)
            at = np.where(one == 1, zeros + ones_at, at - ones_at)
        return symbols, at - low


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling.

    Only suffixes that still tie are sorted again. The last value must be smaller
    than, and different from, every other; then no two suffixes stay alike.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    starts = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    slots = np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    step = 1
    while len(slots):
        rows = order[slots]
        key = rank[rows] * (n + 1) + rank[np.minimum(rows + step, n - 1)] + 1
        by_key = np.argsort(key, kind="stable")
        rows, key = rows[by_key], key[by_key]
        order[slots] = rows
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
        step *= 2
    return order


class FMIndex:
    """Runs of symbols (from 1 on), each ended by a terminator of its own, ready for backward search."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 16):
        """``symbols`` holds the runs one after another, every one ended by a 0.

        The position of every ``sample``-th symbol and of each run's first one is kept;
        others are found by stepping back to one of these.
        """
        n = len(symbols)
        self.symbols, ends = symbols, symbols == 0
        # Terminators are all different and smaller than any symbol, the last one least.
        total = int(ends.sum())
        ranks = np.where(ends, (np.cumsum(ends) % max(total, 1)), symbols.astype(np.int64) + total)
        order = suffix_order(ranks)
        preceding = symbols[order - 1].astype(np.int64)
        preceding[order == 0] = 0
        self.matrix = WaveletMatrix(preceding, largest)
        counts = np.bincount(symbols, minlength=largest + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        first = np.concatenate([[True], ends[:-1]]) if n else ends
        kept = (np.arange(n) % sample == 0) | first
        is_sampled = kept[order]
        self.sampled, self.positions = Bits(is_sampled.astype(np.uint8)), order[is_sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase (one per line, all of one length), as low and high."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.symbols), dtype=np.int64)
        left = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[left, column].astype(np.int64)
            low[left] = self.before[symbol] + self.matrix.rank(symbol, low[left])
            high[left] = self.before[symbol] + self.matrix.rank(symbol, high[left])
            left = left[low[left] < high[left]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the sequence of every row's suffix."""
        found = np.empty(len(rows), dtype=np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.sampled.get(rows) == 1
            found[left[hit]] = self.positions[self.sampled.ones(rows[hit])] + steps
            left, rows, steps = left[~hit], rows[~hit], steps + 1
            symbol, rank = self.matrix.access(rows)
            rows = self.before[symbol] + rank
        return found
