"""Recompression of word sequences: rounds that name runs and pairs, alike wherever they stand.

A round replaces maximal runs of a symbol by one symbol, then every neighbouring pair whose left
symbol is of the one and whose right symbol is of the other of two classes. A name is a
fingerprint of what it stands for and the class is a bit of the name, so the same runs and pairs get
the same names in all documents and all tasks. Which symbols appear inside a stretch of words
depends on a few words around them only; each symbol carries the stretch that settles it
(its context): wherever these words stand, this symbol stands. An end of a document settles
nothing, as the same words can go on elsewhere.

`window_symbols` gives each window of words one symbol whose context lies in the window,
chosen by length class, then by fingerprint. So windows with equal words have equal symbols, and
neighbouring windows mostly share theirs: a document has far fewer symbols than windows.
"""

from __future__ import annotations

import numpy as np

from newsflow.llm.words import Words, mix

ROUNDS = 5
_FAR = 1 << 40
_PAIR = np.array([0xA0761D6478BD642F], np.uint64)
_RUN = np.array([0xE7037ED1A0B428DB], np.uint64)
_CLASS = np.array([0x8EBC6AF09C88C6E3], np.uint64)


def _rank(name: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Order among symbols of a window: medium length first, for it is both telling and long-lived."""
    kind = np.select([span == 1, span == 2, span <= 6], [0, 1, 3], 2).astype(np.uint64)
    return (kind << np.uint64(62)) | (mix(name + _CLASS) >> np.uint64(2))


def window_symbols(words: Words, prints: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """For each word of the slice: the symbol of the window that begins there (without meaning where none does)."""
    n = len(prints)
    best = np.zeros((width + 1, n), np.uint64)  # by context length and first word of the context
    doc = words.doc

    def offer(name: np.ndarray, span: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        size = right - left
        fits = np.flatnonzero(size <= width)
        # The outer words of the context count too: they tell more symbols apart at no cost.
        full = name[fits] + mix(prints[left[fits]] * _PAIR + prints[right[fits] - 1])
        np.maximum.at(best.reshape(-1), size[fits] * n + left[fits], _rank(full, span[fits]))

    at = np.arange(n)
    best[1] = _rank(prints, np.ones(n, np.int64))
    name, a, b, left, right, own = prints, at, at + 1, at, at + 1, doc
    for level in range(rounds):
        if len(name) < 2:
            break
        # Runs.
        head = np.append(True, (name[1:] != name[:-1]) | (own[1:] != own[:-1]))
        heads = np.flatnonzero(head)
        # A run that reaches out of a window may go on differently elsewhere: for its neighbours only its nearest element counts.
        final_right, first_left = right[heads[1:]], left[heads[1:] - 1]
        if len(heads) < len(name):
            count = np.diff(heads, append=len(name))
            last = heads + count - 1
            left, right = np.minimum.reduceat(left, heads), np.maximum.reduceat(right, heads)
            a, b, own = a[heads], b[last], own[heads]
            single = name[heads]
            name = np.where(count > 1, mix(single * _RUN + count.astype(np.uint64)), single)
        else:
            count = np.ones(len(name), np.int64)
        # A neighbour is another symbol for sure if its nearest word differs, else if it is settled itself.
        first, final = np.append(True, own[1:] != own[:-1]), np.append(own[1:] != own[:-1], True)
        before = np.append(-_FAR, np.where(prints[a[1:] - 1] != prints[b[1:] - 1], a[1:] - 1, first_left))
        after = np.append(np.where(prints[np.minimum(b[:-1], n - 1)] != prints[a[:-1]], b[:-1] + 1, final_right), _FAR)
        left = np.minimum(left, np.where(first, -_FAR, before))
        right = np.maximum(right, np.where(final, _FAR, after))
        runs = count > 1
        if runs.any():
            offer(name[runs], (b - a)[runs], left[runs], right[runs])
        # Pairs.
        upper = (mix(name + _CLASS * np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
        joins = ~upper[:-1] & upper[1:] & ~first[1:]
        starts = np.append(joins, False)
        ends = np.append(False, joins)
        alone = ~starts & ~ends
        reach_right = np.append(np.where(first[1:], _FAR, right[1:]), _FAR)
        reach_left = np.append(-_FAR, np.where(first[1:], -_FAR, left[:-1]))
        new_left = np.where(alone & upper, np.minimum(left, reach_left), left)
        new_right = np.where(alone & ~upper, np.maximum(right, reach_right), right)
        i = np.flatnonzero(starts)
        name, b = name.copy(), b.copy()
        name[i] = mix(name[i] * _PAIR + mix(name[i + 1]))
        b[i] = b[i + 1]
        new_left[i] = np.minimum(left[i], left[i + 1])
        new_right[i] = np.maximum(right[i], right[i + 1])
        offer(name[i], b[i] - a[i], new_left[i], new_right[i])
        keep = ~ends
        name, a, b, left, right, own = name[keep], a[keep], b[keep], new_left[keep], new_right[keep], own[keep]
    for size in range(2, width + 1):
        np.maximum(best[size], best[size - 1], out=best[size])
    out = best[width].copy()
    for step in range(1, min(width, n)):
        np.maximum(out[:n - step], best[width - step][step:], out=out[:n - step])
    return out
