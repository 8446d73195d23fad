"""Token ids of whole texts by a tokenizer file, encoding each distinct piece of a batch once.

A text is cut where no token can cross: before the words of a tokenizer that drops white space, or
before a single space or line feed between other characters for one that keeps it (the space belongs to
the word behind it), and before a mark behind a letter. The pieces go through the tokenizers library; texts repeat most of them, so each
is encoded once per batch and frequent ones once per task. A table of pieces of bounded size is kept while a task runs.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from newsflow.llm.words import _BLANK, raw_bytes, slices

#: Bytes that a worker's table of pieces may take (counted at 230 for each, its text and its ids), and bytes of text that it works on at once.
REMEMBERED, SLICE = 96 << 20, 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
# Last and last but one bytes of white space outside ASCII, and its first bytes.
_LAST, _INNER, _FIRST = (np.zeros(256, bool) for _ in range(3))
_LAST[[0x85, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F, 0xA0]] = True
_INNER[[0xC2, 0x9A, 0x80, 0x81]] = True
_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True


# Letters that end a run of letters when one of these marks follows; "|" is left out, as special tokens hold it.
_LETTER, _LATIN, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # behind 0xC3, without the signs for times and divided by
_MARK[[*b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"]] = True


def mark_cuts(data: np.ndarray) -> np.ndarray:
    """Marks right behind a letter. A split pattern never has both in one part."""
    at = np.flatnonzero(_MARK[data[1:]]) + 1
    before = data[at - 1]
    letter = _LETTER[before] | (_LATIN[before] & (data[np.maximum(at - 2, 0)] == 0xC3) & (at > 1))
    return at[letter]


def word_cuts(data: np.ndarray) -> np.ndarray:
    """First bytes of words, then marks behind letters: for tokenizers that drop white space."""
    blank = _BLANK[data]
    return np.concatenate([np.flatnonzero(~blank[1:] & blank[:-1]) + 1, mark_cuts(data)])


def plain_space_cuts(data: np.ndarray, among: tuple[int, ...] = (32,)) -> np.ndarray:
    """Single spaces (or other bytes of ``among``) between other characters."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.isin(data[1:-1], among)) + 1
    before, after = data[at - 1], data[at + 1]
    odd = _SPACE[before] | _SPACE[after] | _FIRST[after] | (_LAST[before] & _INNER[data[np.maximum(at - 2, 0)]])
    return at[~odd]


def space_cuts(data: np.ndarray) -> np.ndarray:
    """Single spaces and line feeds between other characters, then marks behind letters: for tokenizers that keep white space."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.concatenate([plain_space_cuts(data, (32, 10)), mark_cuts(data)])


@dataclass
class Ids:
    """Ids of the rows of a slice; ``first[i]:first[i + 1]`` are those of row i."""

    ids: np.ndarray
    first: np.ndarray


class PieceEncoder:
    """Whole texts to ids. ``cuts`` finds where texts may be cut."""

    def __init__(self, path: str, cuts, encode=None) -> None:
        if encode is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def encode(pieces: list[str]) -> list[list[int]]:
                return [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        self.encode, self.cuts = encode, cuts
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.bytes = 0

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 20_000):
            part = pieces[i:i + 20_000]
            found = self.encode(part)
            sizes = np.array([len(x) for x in found], np.int64)
            new = np.fromiter((y for x in found for y in x), np.uint32, int(sizes.sum()))
            while self.used + len(new) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.place) + len(part) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            at = len(self.place)
            self.flat[self.used:self.used + len(new)] = new
            self.start[at:at + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[at:at + len(part)] = sizes
            self.used += len(new)
            self.place.update(zip(part, range(at, at + len(part))))
            self.bytes += 230 * len(part) + sum(map(len, part)) + 4 * len(new)

    def pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, which of them follow each other, and how many each row has."""
        data, rows = raw_bytes(column)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(rows) - 1, np.int64)
        cut = np.zeros(len(data), bool)
        cut[rows[:-1][np.diff(rows) > 0]] = True
        cut[self.cuts(data)] = True
        begin = np.flatnonzero(cut)
        # A cut found across two rows is a row's beginning or inside one; rows always begin anew.
        ends = np.append(begin, len(data))
        parts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.diff(np.searchsorted(begin, rows))

    def known(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the table, which learns those it lacks."""
        if self.bytes > REMEMBERED:
            self._forget()
        missing = [x for x in pieces if x not in self.place]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, column: pa.Array) -> Ids:
        distinct, which, counts = self.pieces(column)
        place = self.known(distinct.to_pylist())[which] if len(which) else np.zeros(0, np.int64)
        size = self.size[place]
        sums = np.concatenate([[0], np.cumsum(size)])
        total = int(sums[-1])
        at = np.arange(total) + np.repeat(self.start[place] - sums[:-1], size)
        return Ids(self.flat[at], sums[np.concatenate([[0], np.cumsum(counts)])])


def encoded(batches: Iterator[pa.RecordBatch], encoder: PieceEncoder, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, Ids]]:
    """Slices of the batches with their ids. The encoder's table goes when the task ends, as the worker serves other stages next."""
    try:
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text, limit):
                yield batch.slice(start, stop - start), encoder(text.slice(start, stop - start))
    finally:
        encoder._forget()


@functools.lru_cache(maxsize=1)
def library_encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """The encoder of a tokenizer file, the last one kept between the tasks of a worker."""
    return PieceEncoder(path, space_cuts if keeps_space else word_cuts)
