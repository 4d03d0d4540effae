"""Compact levels of n-gram tries: Elias-Fano sequences, quantised values, search within a range, mapped memory."""

from __future__ import annotations

import mmap

import numpy as np

#: Places that are looked up at once; bounds the memory of a lookup.
ASKED = 1 << 15

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1, dtype=np.uint8)
#: Place of the k-th one in each byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")


class EliasFano:
    """A monotone sequence: low bits as they are, high bits in unary, with ones counted per 64-bit word."""

    def __init__(self, low: np.ndarray, bits: int, high: np.ndarray, before: np.ndarray):
        self.low, self.bits, self.high, self.before = low, bits, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = min(8, max(0, (top // max(1, n)).bit_length() - 1)) if top > n else 0
        place = (values >> bits) + np.arange(n)
        marks = np.zeros((int(place[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        marks[place] = 1
        high = np.packbits(marks, bitorder="little").view("<u8")
        before = np.r_[0, marks.reshape(-1, 64).sum(axis=1).cumsum()[:-1]].astype("<u4")
        return cls((values & ((1 << bits) - 1)).astype(np.uint8), bits, high, before)

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places: select of the index-th one in the high bits."""
        parts = [self._at(index[k:k + ASKED]) for k in range(0, len(index), ASKED)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _at(self, index: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, index, side="right") - 1
        row = np.arange(len(index))
        octets = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        seen = _ONES[octets].cumsum(axis=1, dtype=np.uint8)
        left = index - self.before[word]
        octet = (seen <= left[:, None]).sum(axis=1)
        left = left - np.where(octet > 0, seen[row, octet - 1], 0)
        inside = 8 * octet + _SELECT[octets[row, octet], left]
        return (word.astype(np.int64) * 64 + inside - index << self.bits) | self.low[index]


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1..255 and their code book, by quantiles; code 0 is a missing value."""
    known = ~np.isnan(values)
    book = np.zeros(256)
    code = np.zeros(len(values), np.uint8)
    if known.any():
        edges = np.unique(np.quantile(values[known], np.arange(1, 255) / 255))
        place = np.searchsorted(edges, values[known], side="right")
        size = np.bincount(place, minlength=255)
        book[1:] = np.divide(np.bincount(place, values[known], 255), size, out=np.zeros(255), where=size > 0)
        code[known] = place + 1
    return code, book


def successor(keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key within its own range ``low:high`` of sorted keys, or -1: the first key not below
    it is searched by halving, all ranges at once."""
    low, top = low.astype(np.int64), high.astype(np.int64)
    end = top.copy()
    open_ = np.flatnonzero(low < top)
    while len(open_):
        middle = low[open_] + top[open_] >> 1
        less = keys[middle] < wanted[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        top[open_] = np.where(less, top[open_], middle)
        open_ = open_[low[open_] < top[open_]]
    hit = low < end
    hit[hit] = keys[low[hit]] == wanted[hit]
    return np.where(hit, low, -1)


def in_mapped_memory(data: bytes) -> memoryview:
    """The bytes in anonymous mapped memory, which takes no file and goes with its last view."""
    memory = mmap.mmap(-1, max(1, len(data)))
    memory.write(data)
    return memoryview(memory)[:len(data)]
