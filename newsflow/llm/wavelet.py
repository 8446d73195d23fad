"""Wavelet matrix of a sequence of token ids: bit planes with rank directories in one compressed block.

Plane k holds bit k (highest first) of every id, in the order that the planes before have made: at each
plane the ids with a 0 go first, those with a 1 behind them, each in their order. With the number of ones before
any place (rank), a place is followed down the planes to read its id, and a symbol's stretch to count it; going up
again with select finds where it occurs.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
#: Bits between two entries of a plane's rank directory.
BLOCK = 2048


class Plane:
    def __init__(self, packed: np.ndarray, n: int) -> None:
        self.packed, self.n = packed, n
        self.zeros = n - int(np.bitwise_count(packed).sum(dtype=np.int64))

    @functools.cached_property
    def before(self) -> np.ndarray:
        """The rank directory: ones before each block."""
        ones = np.bitwise_count(self.packed).astype(np.int64)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(sums)])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def bit(self, place: int) -> int:
        return int(self.packed[place >> 3] >> (7 - (place & 7))) & 1

    def rank1(self, place: int) -> int:
        """Ones before ``place``."""
        block, byte = place // BLOCK, place >> 3
        count = int(self.before[block]) + int(np.bitwise_count(self.packed[block * (BLOCK // 8):byte]).sum())
        return count + (bin(int(self.packed[byte]) >> (8 - (place & 7))).count("1") if place & 7 else 0)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit``."""
        ends = self.before if bit else np.minimum(np.arange(len(self.before)) * BLOCK, self.n) - self.before
        block = int(np.searchsorted(ends, k, "right")) - 1
        stretch = np.unpackbits(self.packed[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)])[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(stretch == bit)[k - int(ends[block])])


class WaveletMatrix:
    """``n`` ids below 2**``width``."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, ids: np.ndarray, width: int = 16) -> WaveletMatrix:
        order = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for k in range(width - 1, -1, -1):
            ones = (order & order.dtype.type(1 << k)) != 0
            plane = Plane(np.packbits(ones), len(order))
            planes.append(plane)
            back = np.empty_like(order)
            np.compress(ones, order, out=back[plane.zeros:])
            np.compress(np.logical_not(ones, out=ones), order, out=back[:plane.zeros])
            order = back
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last."""
        order = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            ones = plane.bits()
            back = np.empty_like(order)
            back[~ones] = order[:plane.zeros]
            back[ones] = order[plane.zeros:] | order.dtype.type(1 << k)
            order = back
        return order

    def access(self, place: int) -> int:
        out = 0
        for plane in self.planes:
            bit, ones = plane.bit(place), plane.rank1(place)
            place = plane.zeros + ones if bit else place - ones
            out = out << 1 | bit
        return out

    def _stretch(self, symbol: int, stop: int) -> tuple[int, int]:
        """Where the ids equal to ``symbol`` before ``stop`` lie below the last plane."""
        start = 0
        for k, plane in enumerate(self.planes):
            a, b = plane.rank1(start), plane.rank1(stop)
            if symbol >> (len(self.planes) - 1 - k) & 1:
                start, stop = plane.zeros + a, plane.zeros + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, symbol: int, stop: int) -> int:
        """How often ``symbol`` occurs before ``stop``."""
        start, end = self._stretch(symbol, stop)
        return end - start

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``symbol``."""
        start, stop = self._stretch(symbol, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        place = start + k
        for i, plane in enumerate(reversed(self.planes)):
            bit = symbol >> i & 1
            place = plane.select(bit, place - plane.zeros if bit else place)
        return place

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def to_bytes(self) -> bytes:
        """Header, then each plane by itself, so that a reader unpacks only planes it walks through."""
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(p.packed.tobytes()) for p in self.planes]
        return MAGIC + struct.pack("<QI", self.n, len(parts)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, width = struct.unpack_from("<QI", raw, 4)
        sizes = struct.unpack_from(f"<{width}Q", raw, 16)
        at, planes, unpack = 16 + 8 * width, [], zstandard.ZstdDecompressor()
        for size in sizes:
            packed = np.frombuffer(unpack.decompress(raw[at:at + size], max_output_size=n // 8 + 1), np.uint8) if n else np.zeros(0, np.uint8)
            planes.append(Plane(packed, n))
            at += size
        return cls(n, planes)
