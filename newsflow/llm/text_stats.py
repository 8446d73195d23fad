"""Statistics of whole texts, counted for all rows of a batch at once.

Null and empty texts have zero words and zero in every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from newsflow.llm.words import Words, join_prints, lines_of, members, mix, repeated, slices, windows, word_prints, words_of

_CLASSES = {
    "continuation": [*range(0x80, 0xC0)],
    "symbol": [*b"#*$%&|<>"],
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "stop": [*b".?"],
    "bang": [*b"!"],
    "bar": [*b"|"],
    "mark": [*b"\"'(),-:;/@[\\]^_`{}~=+"],
    "lead": [*range(0xC0, 256)],
    "feed": [10],
    "control": [*range(9), *range(14, 32), 127],
}


def byte_counts(words: Words) -> np.ndarray:
    """How often each of the 256 bytes occurs in each row."""
    n = len(words.rows) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) << 8, np.diff(words.rows))
    return np.bincount(row + words.data, minlength=n << 8).reshape(n, 256)


def _distinct_per_row(doc: np.ndarray, prints: np.ndarray, n: int) -> np.ndarray:
    keys = mix(prints ^ mix(doc.astype(np.uint64)))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(doc[at], minlength=n)


def basic(words: Words, prints: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-window counts of each row."""
    n, doc, rows = len(words.rows) - 1, words.doc, words.rows
    bytes_ = byte_counts(words)
    tables = {name: bytes_[:, members_].sum(axis=1) for name, members_ in _CLASSES.items()}
    blanks = bytes_[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    n_bytes = np.diff(rows)
    lines = lines_of(words)
    at = lines.with_word
    n_lines = np.bincount(lines.doc[at], minlength=n)
    # Windows of three words that occur twice in their row.
    begin = windows(words, 3)
    keys = mix(join_prints(prints, 3)[begin] ^ mix(doc[begin].astype(np.uint64))) if len(begin) else np.zeros(0, np.uint64)
    hit = begin[members(keys, repeated(keys))]
    covered = np.zeros(len(prints), bool)
    for step in range(3):
        covered[hit + step] = True
    return {
        "n_words": words.counts, "word_chars": n_bytes - blanks - tables["continuation"], "n_symbols": tables["symbol"],
        "n_dup_lines": n_lines - _distinct_per_row(lines.doc[at], lines.prints[at], n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n), "n_lines": n_lines, "n_bytes": n_bytes,
    } | {f"n_{k}": v for k, v in tables.items()}


SHAPES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_per_word",
    "stop_per_word", "bar_per_word", "mark_share", "foreign_share", "line_words", "distinct_share", "twin_share", "control_share",
)


def shapes(words: Words, prints: np.ndarray, counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of relative statistics per text, in the order of SHAPES."""
    n, doc = len(words.rows) - 1, words.doc
    n_words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    twins = (prints[1:] == prints[:-1]) & (doc[1:] == doc[:-1]) if len(prints) > 1 else np.zeros(0, bool)
    letters = np.maximum(counts["n_upper"] + counts["n_lower"] + counts["n_lead"], 1)
    columns = [
        np.log1p(counts["n_words"]), np.log1p(counts["word_chars"] / n_words), counts["n_symbols"] / chars,
        counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1), counts["n_repeat_words"] / n_words, counts["n_upper"] / letters,
        counts["n_digit"] / chars, counts["n_bang"] / n_words, counts["n_stop"] / n_words, counts["n_bar"] / n_words,
        counts["n_mark"] / chars, counts["n_lead"] / letters, np.log1p(counts["n_words"] / np.maximum(counts["n_lines"], 1)),
        _distinct_per_row(doc, prints, n) / n_words, np.bincount(doc[1:][twins], minlength=n) / n_words if len(twins) else np.zeros(n),
        counts["n_control"] / chars,
    ]
    return np.column_stack(columns).astype(np.float64)


def scan(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Bounded slices of the batches, with their words and fingerprints."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for start, stop in slices(column):
            words = words_of(column.slice(start, stop - start))
            yield batch.slice(start, stop - start), words, word_prints(words)
