"""A two-level n-gram trie over Elias-Fano coded levels, looked up many queries at a time.

Level one holds the contexts, level two their followers, context after context; both
are rising sequences of integers, so each value costs a few bits above its low part.
Pointers from a context to its first follower rise as well and are coded alike.
Log probabilities are whole steps of a fixed size. All levels are flat buffers that
are looked at where they lie, as a memory map would, without unpacking them first.
"""

from __future__ import annotations

import numpy as np

FOLLOWER_BITS = 32
# Quantised log10 probabilities: this many steps per unit, in 16 bits.
STEPS = 5_000

_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
_NTH_ZERO = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    _zeros = [i for i in range(8) if not _b >> (7 - i) & 1]
    _NTH_ZERO[_b, : len(_zeros)] = _zeros
_NTH_ONE = _NTH_ZERO[255 - np.arange(256)]


class EliasFano:
    """A rising sequence of unsigned integers: low bits plain, high bits in unary."""

    def __init__(self, values: np.ndarray, bits: int):
        """``bits``: every value is below ``2**bits`` (at most 64)."""
        values = values.astype(np.uint64)
        self.size = len(values)
        self.low_bits = max(0, bits - max(self.size, 1).bit_length())
        shift = np.uint64(self.low_bits)
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= self.low_bits)
        self.low = (values & ((np.uint64(1) << shift) - np.uint64(1))).astype(width)
        high = (values >> shift).astype(np.int64)
        self.buckets = (int(high[-1]) if self.size else 0) + 1
        marks = np.zeros(self.size + self.buckets, dtype=bool)
        marks[high + np.arange(self.size)] = True
        self.high = np.packbits(marks)
        ones = _ONES[self.high].astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = 8 * np.arange(len(self.high) + 1) - self.ones_before

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes

    def _select(self, before: np.ndarray, nth_in_byte: np.ndarray, rank: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(before, rank, side="right") - 1
        return 8 * byte + nth_in_byte[self.high[byte], rank - before[byte]]

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        index = np.asarray(index, dtype=np.int64)
        high = self._select(self.ones_before, _NTH_ONE, index) - index
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low[index].astype(np.uint64)

    def successor(self, values: np.ndarray, start=None, end=None) -> np.ndarray:
        """The first place, of those from start up to end, whose value is no smaller.

        Without such a place the result is ``end``.
        """
        values = values.astype(np.uint64)
        start = np.zeros(len(values), np.int64) if start is None else start
        end = np.full(len(values), self.size, np.int64) if end is None else end
        if not self.size:
            return end.copy()
        shift = np.uint64(self.low_bits)
        bucket = np.minimum(values >> shift, np.uint64(self.buckets)).astype(np.int64)
        inside = bucket < self.buckets
        at_bucket = np.minimum(bucket, self.buckets - 1)
        last = self._select(self.zeros_before, _NTH_ZERO, at_bucket) - at_bucket
        first = np.where(
            at_bucket > 0, self._select(self.zeros_before, _NTH_ZERO, np.maximum(at_bucket - 1, 0)) - at_bucket + 1, 0
        )
        place = np.maximum(np.where(inside, first, self.size), start)
        stop = np.minimum(np.where(inside, last, self.size), end)
        wanted = (values & ((np.uint64(1) << shift) - np.uint64(1))).astype(self.low.dtype)
        # Inside a bucket only the low parts differ, and they rise: halve what is left.
        beyond = np.maximum(stop, place)
        active = np.flatnonzero(place < beyond)
        while len(active):
            middle = (place[active] + beyond[active]) // 2
            less = self.low[middle] < wanted[active]
            place[active[less]] = middle[less] + 1
            beyond[active[~less]] = middle[~less]
            active = active[place[active] < beyond[active]]
        return np.minimum(np.maximum(place, start), end)


class BigramTrie:
    """Log10 probabilities of followers given a context, and the weight of backing off.

    With ``c(a, b)`` the count of a pair, ``c(a)`` of its context and a prior ``mu``: a
    pair that was seen has probability c(a, b) / (c(a) + mu), and what is left,
    mu / (c(a) + mu), is shared among all words by a lower order; the parts of
    seen followers in that share stay unused, so probabilities sum to at most one.
    """

    def __init__(
        self, contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray, totals: dict[int, int], mu: float
    ):
        """Distinct pairs in order, with their counts.

        ``totals``: the counts of contexts of which other tries hold a part.
        """
        a, b = contexts, followers
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = a[1:] != a[:-1]
        starts = np.flatnonzero(fresh)
        names, size = a[starts], np.diff(np.append(starts, len(a)))
        total = np.add.reduceat(counts, starts) if len(starts) else np.empty(0, np.int64)
        if totals:
            known = np.array(sorted(totals), dtype=np.uint64)
            at = np.minimum(np.searchsorted(known, names), len(known) - 1)
            whole = np.array([totals[int(k)] for k in known], dtype=np.int64)
            total = np.where(known[at] == names, whole[at], total)
        self.mu, self.totals = mu, totals
        self.contexts = EliasFano(names, 64)
        self.pointers = EliasFano(np.append(starts, len(a)), max(len(a), 1).bit_length())
        owner = np.repeat(np.arange(len(names), dtype=np.uint64), size)
        bits = FOLLOWER_BITS + max(len(names), 1).bit_length()
        self.followers = EliasFano((owner << np.uint64(FOLLOWER_BITS)) | b.astype(np.uint64), bits)
        self.probability = self._steps(np.log10(counts / (np.repeat(total, size) + mu)))
        self.back_off = self._steps(np.log10(mu / (total + mu)))

    @staticmethod
    def _steps(log10: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(-log10 * STEPS), 65_535).astype(np.uint16)

    def look_up(self, contexts: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its log10 probability, or its back-off weight, and whether it was seen."""
        log10 = np.zeros(len(contexts))
        seen = np.zeros(len(contexts), dtype=bool)
        for key, total in self.totals.items():
            # Here or in another part: the weight is that of the whole context.
            log10[contexts == np.uint64(key)] = np.log10(self.mu / (total + self.mu))
        if not self.contexts.size or not len(contexts):
            return log10, seen
        at = self.contexts.successor(contexts)
        known = at < self.contexts.size
        known[known] = self.contexts[at[known]] == contexts[known].astype(np.uint64)
        rows = np.flatnonzero(known)
        owner = at[rows]
        start, end = self.pointers[owner].astype(np.int64), self.pointers[owner + 1].astype(np.int64)
        wanted = (owner.astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | followers[rows].astype(np.uint64)
        place = self.followers.successor(wanted, start, end)
        hit = place < end
        hit[hit] = self.followers[place[hit]] == wanted[hit]
        log10[rows] = self.back_off[owner] / -STEPS
        log10[rows[hit]] = self.probability[place[hit]] / -STEPS
        seen[rows[hit]] = True
        return log10, seen
