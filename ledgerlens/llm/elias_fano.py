"""Elias-Fano encoding of non-decreasing sequences, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBIII")  # values, universe, low bits, bytes of lows, bytes of highs, samples
#: One in so many set bits of the high part has its place stored.
SAMPLE = 512


class EliasFano:
    """n values below ``universe`` in about n * (2 + log2(universe / n)) bits.

    Each value's low bits are packed side by side; its high bits are a unary code in a bit vector,
    where the i-th set bit at place p gives the high part p - i. select(i) starts from the nearest
    stored place and counts set bits from there.
    """

    def __init__(self, n: int, universe: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.lows, self.highs, self.samples = lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        lows = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, universe, low_bits, lows, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        word = int(self.highs[byte]) >> (place & 7) << (place & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        at = i * self.low_bits
        raw = int.from_bytes(self.lows[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return high << self.low_bits | (raw >> (at & 7)) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        highs = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        out = highs.astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        lows, highs, samples = self.lows.tobytes(), self.highs.tobytes(), self.samples.astype("<u4").tobytes()
        return _HEAD.pack(self.n, self.universe, self.low_bits, len(lows), len(highs), len(self.samples)) + lows + highs + samples

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, low_bits, a, b, c = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        lows, highs = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, universe, low_bits, lows, highs, np.frombuffer(raw, "<u4", c, at + a + b)), at + a + b + 4 * c
