"""Elias-Fano sequences and a two-level n-gram trie laid out flat, so that it can be memory-mapped.

A non-decreasing sequence of n numbers below u keeps the low log2(u / n) bits of each number packed side by side and the
high bits as gaps in a bit vector: about 2 + log2(u / n) bits a number. All reads and searches work on whole arrays of
queries.
"""

from __future__ import annotations

import mmap

import numpy as np

_HEAD = 4  # 64-bit words: numbers, bits of the low part, words of the low part, words of the high part


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` (below 2**bits) packed side by side, lowest bit first, with 8 spare bytes for reads past the end."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8]
    flat = np.unpackbits(raw, axis=1, bitorder="little")[:, :bits]
    return np.append(np.packbits(flat.ravel(), bitorder="little"), np.zeros(8, np.uint8))


def encode(values: np.ndarray) -> bytes:
    """Bytes of the sequence ``values`` (uint64, ascending)."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low_bits = max(0, (top // max(1, n)).bit_length() - 1)
    low = _pack(values & np.uint64((1 << low_bits) - 1), low_bits)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    bits = np.zeros(n + (int(high[-1]) + 1 if n else 0), np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    head = np.array([n, low_bits, -(-len(low) // 8), -(-len(packed) // 8)], "<u8")
    return head.tobytes() + low.tobytes() + bytes(-len(low) % 8) + packed.tobytes() + bytes(-len(packed) % 8)


def _bit_of_rank(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with ``rank`` set bits below it, in each word: halves are halved."""
    place, rank = np.zeros(len(words), np.uint64), rank.astype(np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((words >> place) & np.uint64((1 << size) - 1)).astype(np.int64)
        up = rank >= below
        rank -= np.where(up, below, 0)
        place += np.where(up, np.uint64(size), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """Reads and searches in an encoded sequence at ``offset`` of a buffer, in place: beside the buffer there are two
    counts per 64 high bits, of the ones and of the zeros up to there."""

    def __init__(self, buffer, offset: int = 0):
        n, bits, low, high = (int(x) for x in np.frombuffer(buffer, "<u8", _HEAD, offset))
        at = offset + 8 * _HEAD
        self.n, self.bits, self.end = n, bits, at + 8 * (low + high)
        self._windows = np.ndarray((max(1, 8 * low - 7),), "<u8", buffer, at, (1,))
        self._high = np.ndarray((high,), "<u8", buffer, at + 8 * low)
        kind = np.uint32 if 64 * high < 1 << 32 else np.int64
        self._ones = np.cumsum(np.bitwise_count(self._high), dtype=kind)
        self._zeros = (np.arange(64, 64 * high + 64, 64, dtype=np.int64) - self._ones).astype(kind)
        self._last = int(self._place(np.array([n - 1]), True)[0]) - (n - 1) if n else -1

    def _place(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the ones (or zeros) number ``i`` among the high bits."""
        upto = self._ones if ones else self._zeros
        word = np.searchsorted(upto, i.astype(upto.dtype), side="right")
        before = np.where(word > 0, upto[np.maximum(word, 1) - 1], 0).astype(np.int64)
        bits = self._high[word] if ones else ~self._high[word]
        return 64 * word + _bit_of_rank(bits, i - before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self._windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._place(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """Place of the first number whose high part is at least ``high``: the ones before the zero that ends the part
        before it."""
        out = np.where(high > self._last, self.n, 0)
        some = np.flatnonzero((high > 0) & (high <= self._last))
        out[some] = self._place(high[some] - 1, False) - (high[some] - 1)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least x (n if there is none): the high bits give the range, a binary
        search over the low bits finds the place in it."""
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        lo, hi = self._begin(high), self._begin(high + 1)
        want = x & np.uint64((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at = self.successor(x)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.get(inside) == x), inside, -1)


class Trie:
    """Contexts, pointers to their successors, and quantised values, in one buffer.

    Layout: Elias-Fano contexts; Elias-Fano pointers (contexts + 1); Elias-Fano successors, each written relative to
    its context: its id plus one more than the last number of the context before; one byte per successor; two bytes per
    context."""

    def __init__(self, buffer):
        self.contexts = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, np.uint8, self.successors.n, self.successors.end)
        self.weights = np.frombuffer(buffer, "<u2", self.contexts.n,
                                     self.successors.end + self.successors.n + self.successors.n % 2)

    @staticmethod
    def layout(contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray,
               weights: np.ndarray) -> bytes:
        """``words``: ascending within each context."""
        pointers = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
        last = words[pointers[1:].astype(np.int64) - 1] if len(sizes) else words[:0]
        base = np.concatenate([[0], np.cumsum(last[:-1] + np.uint64(1))]).astype(np.uint64) if len(sizes) else words[:0]
        relative = words + np.repeat(base, sizes)
        return (encode(contexts) + encode(pointers) + encode(relative) + codes.astype(np.uint8).tobytes()
                + bytes(len(codes) % 2) + weights.astype("<u2").tobytes())

    @classmethod
    def mapped(cls, layout: bytes) -> Trie:
        """The trie in an anonymous memory map."""
        held = mmap.mmap(-1, max(1, len(layout)))
        held.write(layout)
        return cls(held)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file, memory-mapped."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the contexts and of the successors within them (-1: none)."""
        at = self.contexts.find(contexts)
        place = np.full(len(at), -1, np.int64)
        known = np.flatnonzero(at >= 0)
        if len(known):
            begin = self.pointers.get(at[known]).astype(np.int64)
            end = self.pointers.get(at[known] + 1).astype(np.int64)
            base = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
            got = self.successors.find(words[known] + base)
            place[known] = np.where((got >= begin) & (got < end), got, -1)
        return at, place
