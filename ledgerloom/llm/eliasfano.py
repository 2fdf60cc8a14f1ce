"""Elias-Fano sequences and quantised values in memory-mapped files."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


class Store:
    """Arrays written one after the other to an unlinked temporary file, then mapped for reading.

    The file has no name, so nothing stays in the folder, and its pages leave memory as needed.
    """

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, np.dtype, int]] = []
        self.size = 0

    def put(self, array: np.ndarray) -> int:
        raw = np.ascontiguousarray(array)
        self.file.write(memoryview(raw).cast("B") if raw.size else b"")
        pad = -raw.nbytes % 8
        self.file.write(b"\0" * pad)
        self.places.append((self.size, raw.dtype, raw.size))
        self.size += raw.nbytes + pad
        return len(self.places) - 1

    def seal(self) -> None:
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def get(self, i: int) -> np.ndarray:
        at, dtype, n = self.places[i]
        return np.frombuffer(self.map, dtype, n, at)


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one in each 64-bit word."""
    place = np.zeros(len(words), np.uint64)
    k = k.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = (words >> place) & np.uint64((1 << step) - 1)
        ones = np.bitwise_count(low).astype(np.uint64)
        over = k >= ones
        k = np.where(over, k - ones, k)
        place += np.where(over, np.uint64(step), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """A sorted sequence of n integers below u: low bits as they are, high bits in unary.

    The high parts are a bit vector with a one for each value and a zero for each high step, with
    running counts of ones by word and the places of the zeros. There are at least about log2(u / n)
    low bits, rounded up to what fits a machine integer, so that the high steps are n at most.
    """

    def __init__(self, store: Store, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.store = n, store
        want = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low, kind = next((x for x in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if want <= x[0]), (want, np.uint64))
        low = min(low, want + 1)
        self.low = np.uint64(low)
        values = values.astype(np.uint64)
        self.lower = store.put((values & np.uint64((1 << low) - 1)).astype(kind))
        high = (values >> self.low).astype(np.int64)
        self.steps = (int(max(0, universe - 1)) >> low) + 1
        bits = np.zeros(-(-(n + self.steps + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.words = store.put(words)
        self.zeros = store.put(np.flatnonzero(bits[: n + self.steps] == 0).astype(np.int32 if len(bits) < 1 << 31 else np.int64))
        self.ones = store.put(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32 if len(bits) < 1 << 31 else np.int64))

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one."""
        ones = self.store.get(self.ones)
        w = np.searchsorted(ones, k, side="right") - 1
        return w * 64 + _in_word(self.store.get(self.words)[w], k - ones[w])

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._one(i) - i) << np.int64(self.low)) | self.store.get(self.lower)[i].astype(np.int64)

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first value not below each x, the end of x's high part, and x's low bits.

        The zeros before and after a high part bound its values; their low bits are searched.
        """
        zeros, lower = self.store.get(self.zeros), self.store.get(self.lower)
        high = np.minimum(x >> np.int64(self.low), self.steps - 1)
        hi = zeros[high] - high
        lo = np.where(high > 0, zeros[high - 1] - high + 1, 0).astype(np.int64)
        want = (x & ((np.int64(1) << np.int64(self.low)) - 1)).astype(lower.dtype)
        on = np.flatnonzero(lo < hi)
        at, left, sought = lo[on], hi[on] - lo[on], want[on]
        while len(on):
            half = left >> 1
            less = lower[at + half] < sought
            at = np.where(less, at + half + 1, at)
            left = np.where(less, left - half - 1, half)
            lo[on] = at
            open_ = np.flatnonzero(left > 0)
            if len(open_) < len(on):
                on, at, left, sought = on[open_], at[open_], left[open_], sought[open_]
        return lo, hi, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not below each x (n where there is none)."""
        return self._successor(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 where it isn't in the sequence."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, end, want = self._successor(x)
        return np.where((at < end) & (self.store.get(self.lower)[np.minimum(at, self.n - 1)] == want), at, -1)


class Quantised:
    """Values as one-byte codes of a codebook of means over up to 256 bins of equal size."""

    def __init__(self, store: Store, values: np.ndarray):
        self.store = store
        if not len(values):
            self.book, self.codes = np.zeros(1), store.put(np.zeros(0, np.uint8))
            return
        distinct, back, counts = np.unique(values, return_inverse=True, return_counts=True)
        if len(distinct) <= 256:
            code = np.arange(len(distinct))
        else:
            share = (np.cumsum(counts) - counts / 2) / len(values)
            code = np.unique((share * 256).astype(np.int64), return_inverse=True)[1]
        self.book = np.bincount(code, distinct * counts) / np.bincount(code, counts)
        self.codes = store.put(code[back].astype(np.uint8))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.store.get(self.codes)[i]]
