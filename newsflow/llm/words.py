"""Words, lines and their fingerprints over Arrow text columns, without a Python step per word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which is what
``[^\\x20\\x09-\\x0D]+`` finds in the decoded text: UTF-8 uses none of these bytes inside
another character. Null texts are empty. Every function works on a slice of a batch whose
size is bounded (`slices`), except that one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_RANDOM = np.random.Generator(np.random.PCG64(20240131))
# One random value per byte; blanks count nothing, so that a sum up to the next word is the word's.
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_LINE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE[_BLANK] = 0
_LINE_VALUE[10] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E6C63D0876A9A63)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    if len(column) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, stop
        start, done = stop, ends[stop - 1]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins in them (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice in reading order; ``first[i]:first[i + 1]`` are those of row i."""

    data: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    first: np.ndarray
    blank: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def end(self) -> np.ndarray:
        """Where each word ends."""
        ends = self.blank.copy()
        ends[self.rows[(self.rows > 0) & (self.rows < len(self.data))]] = True  # a row ends here at the latest
        stop = np.append(np.flatnonzero(ends), len(self.data))
        return np.minimum(stop[np.searchsorted(stop, self.start, "right")], len(self.data))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, rows = raw_bytes(column)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = rows[rows < len(data)]
    begins[inner] = ~blank[inner]
    start = np.flatnonzero(begins)
    return Words(data, rows, start, np.searchsorted(start, rows), blank)


def _sums(values: np.ndarray, start: np.ndarray, total: int) -> np.ndarray:
    """Fingerprints of the segments between starts, from one value per byte (0: not counted)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = np.diff(start, append=total)
    place = np.arange(start[0], total) - np.repeat(start, lengths)
    values = values[start[0]:] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, start - start[0]))


def word_prints(words: Words) -> np.ndarray:
    """64-bit fingerprint of every word. Equal words have equal fingerprints, everywhere."""
    return _sums(_BYTE_VALUE[words.data], words.start, len(words.data))


@dataclass
class Lines:
    """Parts between line feeds of a slice's rows, an empty row has one."""

    doc: np.ndarray
    prints: np.ndarray
    with_word: np.ndarray


def lines_of(words: Words) -> Lines:
    data, rows = words.data, words.rows
    feeds = np.flatnonzero(data == 10)
    filled = rows[:-1][np.diff(rows) > 0]
    start = np.union1d(filled, feeds + 1)
    start = start[start < len(data)]
    # A row's last line can be empty and begin where the next row does; an empty line has no word.
    doc = np.searchsorted(rows, start, "right") - 1
    marks = np.searchsorted(words.start, start)
    with_word = np.diff(marks, append=len(words.start)) > 0
    return Lines(doc, _sums(_LINE_VALUE[data], start, len(data)), with_word)


def join_prints(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of ``width`` neighbours, over all rows as one sequence."""
    n = len(prints) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = powers(width + 1)[1:]
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += prints[i:i + n] * weights[i]
    return mix(out)


def windows(words: Words, width: int) -> np.ndarray:
    """Places of words with which ``width`` words of one row begin."""
    ends = words.first[1:]
    at = np.arange(len(words.start))
    return at[at + width <= np.repeat(ends, words.counts)]


def members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``: a bit table first, then exactly."""
    out = np.zeros(len(values), bool)
    if not len(among) or not len(values):
        return out
    bits = max(16, int(len(among)).bit_length() + 4)
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[among >> shift] = True
    maybe = np.flatnonzero(table[values >> shift])
    at = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
    out[maybe] = among[at] == values[maybe]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys that occur more than once."""
    ordered = np.sort(keys)
    same = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(same)
