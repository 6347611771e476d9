"""Elias-Fano codes of non-decreasing sequences, with select and search."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBxxxxxxx")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The place of the k-th set bit of a byte.
_PLACE = np.array([([j for j in range(8) if i >> j & 1] + [8] * 8)[:8] for i in range(256)], np.int64)
#: Queries that are answered at a time.
_CHUNK = 8192


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of each value, one after another, little-endian."""
    if not bits or not len(values):
        return np.zeros(0, np.uint8)
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values: every chunk ends on a byte
        part = values[at : at + (1 << 16)].astype("<u8")
        rows = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(rows.ravel(), bitorder="little"))
    return np.concatenate(out)


def unpack(data: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    """The values at ``index`` of what ``pack`` wrote, with 8 bytes after it; ``bits`` is at most 56."""
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * bits
    first = at >> 3
    out = np.zeros(len(index), np.uint64)
    for k in range((bits + 14) // 8):
        out |= data[first + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)


def encode(values: np.ndarray, universe: int) -> bytes:
    """Code ``values`` (non-decreasing, each at most ``universe``) in 2 + log2(universe / n) bits a value.  Ranks of words of 64
    bits are counted when a view is first asked."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n >= 1 << 29:
        raise ValueError("a code holds fewer than 2^29 values")
    low = min(56, max(0, (int(universe) // max(1, n)).bit_length() - 1)) if n else 0
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = (int(universe) >> low) + n + 1
    upper = np.zeros(-(-size // 64) * 8, np.uint8)
    np.bitwise_or.at(upper, high >> 3, (1 << (high & 7)).astype(np.uint8))
    lower = np.concatenate([pack(values, low), np.zeros(8, np.uint8)])
    return b"".join((_HEAD.pack(n, len(upper), low), struct.pack("<Q", len(lower)), upper.tobytes(), lower.tobytes()))


class EliasFano:
    """A view of an encoded sequence (bytes or a memory map); nothing is copied but what a query touches."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        self.n, uppers, self.low = _HEAD.unpack_from(view, 0)
        (lowers,) = struct.unpack_from("<Q", view, _HEAD.size)
        at = _HEAD.size + 8
        self.upper = np.frombuffer(view, np.uint8, uppers, at)
        self.lower = np.frombuffer(view, np.uint8, lowers, at + uppers)
        self.size = at + uppers + lowers

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at the positions ``index``."""
        index = np.asarray(index, np.int64)
        out = np.empty(len(index), np.uint64)
        for at in range(0, len(index), _CHUNK):
            i = index[at : at + _CHUNK]
            place = self._bit(i, False)
            out[at : at + _CHUNK] = ((place - i).astype(np.uint64) << np.uint64(self.low)) | unpack(self.lower, self.low, i)
        return out

    def _bit(self, rank: np.ndarray, zero: bool) -> np.ndarray:
        """The place of the one (or zero) bit of a rank from 0 among the upper bits."""
        if not hasattr(self, "_before"):  # ones, and zeros, before each word of 64 bits
            ones = np.bitwise_count(np.frombuffer(self.upper, "<u8")).astype(np.int32)
            ones = np.cumsum(ones, dtype=np.int32) - ones
            self._before = ones, np.arange(len(ones), dtype=np.int32) * 64 - ones
        word = np.searchsorted(self._before[zero], rank.astype(np.int32), "right") - 1
        rank = rank - self._before[zero][word]
        bits = self.upper.reshape(-1, 8)[word]
        bits = ~bits if zero else bits
        upto = np.cumsum(_ONES[bits], 1, dtype=np.int8)
        byte = (upto <= rank[:, None].astype(np.int8)).sum(1)
        row = np.arange(len(word))
        inside = rank - np.where(byte > 0, upto[row, byte - 1], 0)
        return word * 64 + byte * 8 + _PLACE[bits[row, byte], inside]

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have upper bits under ``high``: the ones before the zero that ends the bucket under it."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        rank = high[some] - 1
        out[some] = self._bit(rank, True) - rank
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The position of each of ``values`` between the positions ``begin`` and ``end`` (default: anywhere), or -1.

        The upper bits name a bucket of positions; within it and the given range the lower bits are searched by halves.
        """
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        for at in range(0, len(values), _CHUNK):
            x = values[at : at + _CHUNK]
            high = np.minimum(x >> np.uint64(self.low), np.uint64(len(self.upper) * 8 - self.n)).astype(np.int64)
            lo, hi = self._below(high), self._below(np.minimum(high + 1, len(self.upper) * 8 - self.n))
            if begin is not None:
                lo, hi = np.maximum(lo, begin[at : at + _CHUNK]), np.minimum(hi, end[at : at + _CHUNK])
            wanted, last = x & np.uint64((1 << self.low) - 1), hi.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # the first position whose lower bits are no less
                middle = (lo[open_] + hi[open_]) >> 1
                less = unpack(self.lower, self.low, middle) < wanted[open_]
                lo[open_[less]] = middle[less] + 1
                hi[open_[~less]] = middle[~less]
                open_ = open_[lo[open_] < hi[open_]]
            some = np.flatnonzero(lo < last)
            hit = some[unpack(self.lower, self.low, lo[some]) == wanted[some]]
            out[at + hit] = lo[hit]
        return out

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little")).astype(np.int64)[: self.n]
        index = np.arange(self.n)
        return ((ones - index).astype(np.uint64) << np.uint64(self.low)) | unpack(self.lower, self.low, index)
