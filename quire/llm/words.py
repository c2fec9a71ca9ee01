"""Vectorised word hashing of Arrow text columns, shared by the operators on word windows.

Words are maximal runs of bytes that are not ASCII white space. A word's hash is a polynomial
over random byte values modulo 2^64, taken for all words of a buffer at once from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
#: Bytes hashed at a time; bounds the working memory.
BLOCK = 1 << 20
#: Bytes of text in a slice where what is made of a slice is better counted or packed together; takes some 50 times as much memory.
WIDE = 4 * BLOCK

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK + 4096)
        one = np.ones(1, U64)
        _powers = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE, U64)]))
        _inverse = np.cumprod(np.concatenate([one, np.full(size - 1, pow(_BASE, -1, 2**64), U64)]))
    return _powers, _inverse


class Words:
    """Words of a batch of texts: byte bounds, counts per text and offsets of each text's words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        """``data``: bytes of all texts; ``bounds``: where each text starts, and the end."""
        self.data = data
        n = len(data)
        word = ~IS_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = bounds[(bounds > 0) & (bounds < n)]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word; equal words have equal hashes wherever they stand."""
        return hash_spans(self.data, self.starts, self.ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), which must be in order and apart."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        powers, inverse = _power_tables(hi - lo + 1)
        sums = np.empty(hi - lo + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[data[lo:hi]] * powers[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, width: int, step: int = _STEP) -> np.ndarray:
    """Rabin-Karp hashes to base ``step`` of all windows of ``width`` consecutive word hashes (texts run together)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= U64(step)
        out += words[k : k + n]
    return mix(out)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Indices of words that start a whole window within their own text."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(counts.sum())
    base = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return base + np.arange(total)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, bounds = text_buffer(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
