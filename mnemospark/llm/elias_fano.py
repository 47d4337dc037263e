"""Elias-Fano coding of non-decreasing numbers: low bits packed, high parts in unary, with select samples."""

from __future__ import annotations

import struct

import numpy as np

#: One of so many ones in the upper bits has its position sampled.
SAMPLE = 256
_HEAD = struct.Struct("<QQIIQ")  # count, largest, low bits, samples, bytes of the upper part


class EliasFano:
    """About 2 + log2(largest / count) bits a number; ``select(i)`` returns number i without decoding the others."""

    def __init__(self, count: int, largest: int, low: int, lows: np.ndarray, upper: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.largest, self.low, self.lows, self.upper, self.samples = count, largest, low, lows, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n and np.any(v[1:] < v[:-1]):
            raise ValueError("numbers must not decrease")
        largest = int(v[-1]) if n else 0
        low = max(0, (largest // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, largest, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.count, self.largest, self.low, len(self.samples), len(self.upper))
        return head + self.lows.tobytes() + self.upper.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        count, largest, low, n_samples, n_upper = _HEAD.unpack_from(b)
        at, n_low = _HEAD.size, (count * low + 7) // 8
        lows = np.frombuffer(b, np.uint8, n_low, at)
        upper = np.frombuffer(b, np.uint8, n_upper, at + n_low)
        return cls(count, largest, low, lows, upper, np.frombuffer(b, "<u4", n_samples, at + n_low + n_upper))

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first, end = i * self.low, (i + 1) * self.low
        word = int.from_bytes(self.lows[first // 8 : (end + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Number i, from the nearest sample on."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, want = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while True:
            ones = np.flatnonzero(bits)
            if want < len(ones):
                return ((byte * 8 + int(ones[want]) - i) << self.low) | self._low(i)
            want -= len(ones)
            byte += len(bits) // 8
            bits = np.unpackbits(self.upper[byte : byte + 64], bitorder="little")

    def selects(self, first: int, end: int) -> np.ndarray:
        """Numbers first to end - 1, each from its one in the upper part: the nearest sample on, and no further than they need."""
        if not 0 <= first <= end <= self.count:
            raise IndexError((first, end))
        n = end - first
        if not n:
            return np.zeros(0, np.uint64)
        at, to = int(self.samples[first // SAMPLE]), -(-end // SAMPLE)
        stop = int(self.samples[to]) + 1 if to < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[at // 8 : (stop + 7) // 8], bitorder="little")
        bits[: at % 8] = 0
        ones = np.flatnonzero(bits)[first % SAMPLE :][:n].astype(np.uint64) + np.uint64(8 * (at // 8))
        high = (ones - np.arange(first, end, dtype=np.uint64)) << np.uint64(self.low)
        if not self.low:
            return high
        begin = first * self.low
        bits = np.unpackbits(self.lows[begin // 8 : (end * self.low + 7) // 8], bitorder="little")[begin % 8 :][: n * self.low].reshape(n, self.low)
        return high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        return self.selects(0, self.count)
