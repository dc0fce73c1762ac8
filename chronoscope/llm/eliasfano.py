"""Elias-Fano coding of a non-decreasing sequence, with a select structure.

n values below u take about n * (2 + log2(u / n)) bits: the low bits of each value
lie side by side, the high bits are a bit vector in which value i sets bit
``high(i) + i``. Sampled positions of set bits make ``select`` read a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

#: A position is kept for every so many set bits.
SAMPLE = 256
HEADER = struct.Struct("<QQQBxxxxxxx")


def encode(values: np.ndarray) -> bytes:
    """The coded form of non-negative, non-decreasing values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return HEADER.pack(0, 0, 0, 0)
    low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
    bits = np.zeros(n * low_bits, np.uint8)
    for k in range(low_bits):
        bits[k::low_bits] = (values >> np.uint64(k)) & np.uint64(1)
    low = np.packbits(bits, bitorder="little").tobytes()
    at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, np.uint8)
    high[at] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    samples = at[::SAMPLE].astype("<u4" if at[-1] < 1 << 32 else "<u8")
    return HEADER.pack(n, len(low), len(packed), low_bits | (64 if samples.itemsize == 8 else 0)) + low + packed + samples.tobytes()


class EliasFano:
    """Reads what ``encode`` gives."""

    def __init__(self, data: bytes):
        self.n, low, high, kind = HEADER.unpack_from(data)
        self.low_bits = kind & 63
        at = HEADER.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        wide = np.dtype("<u8" if kind & 64 else "<u4")
        self.samples = np.frombuffer(data, wide, -(-self.n // SAMPLE), at + low + high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.range(i, i + 1)[0])

    def range(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop - 1, read from the nearest sampled bit before."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError(f"{start}:{stop} of {self.n} values")
        if start == stop:
            return np.zeros(0, np.int64)
        first, last = start // SAMPLE, -(-stop // SAMPLE)
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        skip = int(np.searchsorted(ones, int(self.samples[first]))) + start - first * SAMPLE
        index = np.arange(start, stop)
        values = (ones[skip : skip + len(index)] - index) << self.low_bits
        if self.low_bits:
            bit = index * self.low_bits
            from_byte, to_byte = int(bit[0]) // 8, int(bit[-1] + self.low_bits - 1) // 8 + 1
            bits = np.unpackbits(self.low[from_byte:to_byte], bitorder="little")
            bit -= from_byte * 8
            for k in range(self.low_bits):
                values |= bits[bit + k].astype(np.int64) << k
        return values
