"""Wavelet matrix of token ids: compressed bit planes with rank and select."""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"WVMX1"
#: Bits per separately compressed block of a plane.
BLOCK_BITS = 1 << 17
_HEAD = struct.Struct("<5sBQ")


def build(ids: np.ndarray, levels: int) -> bytes:
    """File of a sequence of ids below ``2 ** levels``.

    One plane per bit, from the highest; below each, the sequence is parted stably by that bit, zeros
    first. A plane holds its number of zeros, the ones before every block, the blocks' offsets and
    the blocks, each compressed by itself.
    """
    if len(ids) and int(ids.max()) >> levels:
        raise ValueError("an id is too large for the number of levels")
    x = np.array(ids, np.uint16 if levels <= 16 else np.uint32)
    y = np.empty_like(x)
    press = zstandard.ZstdCompressor(level=1)
    planes = []
    for level in range(levels):
        mask = x.dtype.type(1 << (levels - 1 - level))
        blocks, before, n_ones = [], [], 0
        ones = np.empty_like(x)
        for i in range(0, len(x), BLOCK_BITS):  # what is parted at a time stays in the processor's cache
            part = x[i : i + BLOCK_BITS]
            bit = (part & mask) != 0
            blocks.append(press.compress(np.packbits(bit, bitorder="little")))
            before.append(n_ones)
            one, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
            ones[n_ones : n_ones + len(one)] = part[one]
            y[i - n_ones : i - n_ones + len(zero)] = part[zero]
            n_ones += len(one)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
        planes.append(struct.pack("<QQ", len(x) - n_ones, len(blocks)) + np.array(before, "<u8").tobytes() + offsets.tobytes() + b"".join(blocks))
        y[len(x) - n_ones :] = ones[:n_ones]
        x, y = y, x
    return _HEAD.pack(MAGIC, levels, len(ids)) + struct.pack(f"<{levels}Q", *map(len, planes)) + b"".join(planes)


class _Plane:
    def __init__(self, data: memoryview, n: int) -> None:
        self.n = n
        self.zeros, count = struct.unpack_from("<QQ", data)
        self.before = np.frombuffer(data, "<u8", count, 16)
        self.offsets = np.frombuffer(data, "<u8", count + 1, 16 + 8 * count)
        self.blob = data[16 + 8 * (2 * count + 1) :]
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()

    def _raw(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.blob[int(self.offsets[k]) : int(self.offsets[k + 1])])

    def block(self, k: int) -> np.ndarray:
        if k not in self.cache:
            self.cache[k] = np.frombuffer(self._raw(k), np.uint8)
            if len(self.cache) > 8:
                self.cache.popitem(last=False)
        return self.cache[k]

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(ones before it, its bits) of each block."""
        for k, seen in enumerate(self.before.tolist()):
            raw = np.frombuffer(self._raw(k), np.uint8)
            yield seen, np.unpackbits(raw, count=min(BLOCK_BITS, self.n - k * BLOCK_BITS), bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        k, j = divmod(i, BLOCK_BITS)
        return int(self.block(k)[j >> 3] >> (j & 7)) & 1

    def ones(self, i: int) -> int:
        """Ones before position i."""
        if i >= self.n:
            return self.n - self.zeros
        k, j = divmod(i, BLOCK_BITS)
        block = self.block(k)
        part = int(np.bitwise_count(block[: j >> 3]).sum())
        if j & 7:
            part += (int(block[j >> 3]) & ((1 << (j & 7)) - 1)).bit_count()
        return int(self.before[k]) + part

    def select(self, bit: int, r: int) -> int:
        """Position of the r-th (from 0) one or zero."""
        starts = np.arange(len(self.before), dtype=np.int64) * BLOCK_BITS
        seen = self.before.astype(np.int64) if bit else starts - self.before.astype(np.int64)
        k = int(np.searchsorted(seen, r, "right")) - 1
        flat = np.unpackbits(self.block(k), bitorder="little")[: self.n - k * BLOCK_BITS]
        return k * BLOCK_BITS + int(np.flatnonzero(flat == bit)[r - int(seen[k])])


class WaveletMatrix:
    """Reads a file of ``build``: access, counts and occurrences without decoding the whole."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, self.levels, self.n = _HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = _HEAD.size
        sizes = struct.unpack_from(f"<{self.levels}Q", view, at)
        at += 8 * self.levels
        self.planes = []
        for size in sizes:
            self.planes.append(_Plane(view[at : at + size], self.n))
            at += size

    def __len__(self) -> int:
        return self.n

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in self.planes:
            bit = p.bit(i)
            value = value << 1 | bit
            i = p.zeros + p.ones(i) if bit else i - p.ones(i)
        return value

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before ``end``."""
        lo, hi = 0, self.n if end is None else min(end, self.n)
        for level, p in enumerate(self.planes):
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = p.zeros + p.ones(lo), p.zeros + p.ones(hi)
            else:
                lo, hi = lo - p.ones(lo), hi - p.ones(hi)
        return hi - lo

    def find(self, token: int, r: int) -> int:
        """Position of the r-th (from 0) occurrence of an id."""
        if not 0 <= r < self.count(token):
            raise IndexError(r)
        start = 0
        for level, p in enumerate(self.planes):
            bit = token >> (self.levels - 1 - level) & 1
            start = p.zeros + p.ones(start) if bit else start - p.ones(start)
        i = start + r
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self.planes[level].select(bit, i - self.planes[level].zeros if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        y, x = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            p, at = self.planes[level], 0
            for seen, bits in p.parts():
                one, zero = np.flatnonzero(bits), np.flatnonzero(~bits)
                part = x[at : at + len(bits)]
                part[zero] = y[at - seen : at - seen + len(zero)]
                part[one] = y[p.zeros + seen : p.zeros + seen + len(one)] | kind(1 << (self.levels - 1 - level))
                at += len(bits)
            x, y = y, x
        return y
