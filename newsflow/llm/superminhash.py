"""SuperMinHash signatures of shingle sets.

An element's generator draws, slot by slot, a random permutation of the slots: step j gives
the slot at place j of the permutation the value j + u, u uniform in [0, 1). A slot keeps the
smallest value of all elements. As one element's values are a permutation plus noise, slots are
negatively correlated and the estimate of the Jaccard similarity varies less than with independent
hashes. Steps beyond the largest whole part of a signature can't change it, which ends most
elements after a few steps. All elements of a slice take a step together; values are
integers (step in the upper 16 bits, 48 random bits below).
"""

from __future__ import annotations

import numpy as np

from newsflow.llm.words import Words, join_prints, mix, powers, word_prints

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
# Steps for which places are looked up among the swaps so far; later ones keep the whole permutation.
_FEW = 4


def signatures(elements: np.ndarray, doc: np.ndarray, n: int, slots: int) -> np.ndarray:
    """(n, slots) signatures of n sets; ``doc`` says whose each of the distinct ``elements`` is."""
    table = np.full(n * slots, _EMPTY, np.uint64)
    active, owner, j = elements, doc.astype(np.int64), 0
    froms: list[np.ndarray] = []
    stored: list[np.ndarray] = []
    whole: np.ndarray | None = None
    while len(active) and j < slots:
        draw = mix(active + np.array([j + 1], np.uint64) * _STEP)
        place = j + (((mix(draw ^ _SLOT) >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j < _FEW:
            slot, own = _looked_up(place, froms, stored), _looked_up(np.full(len(active), j), froms, stored)
            froms.append(place)
            stored.append(own)
        else:
            if whole is None:
                whole = np.tile(np.arange(slots, dtype=np.int16), (len(active), 1))
                for t in range(j):
                    whole[np.arange(len(active)), froms[t]] = stored[t]
            rows = np.arange(len(active))
            slot = whole[rows, place].astype(np.int64)
            whole[rows, place] = whole[rows, j]
        np.minimum.at(table, owner * slots + slot, (np.uint64(j) << np.uint64(48)) | (draw >> np.uint64(16)))
        j += 1
        # A set is done when no slot holds a value that step j could still beat.
        open_ = np.zeros(n, bool)
        docs = np.unique(owner)
        open_[docs] = (table.reshape(n, slots)[docs] >> np.uint64(48)).max(axis=1) >= j
        go = open_[owner]
        if not go.all():
            active, owner = active[go], owner[go]
            if whole is not None:
                whole = whole[go]
            else:
                froms, stored = [x[go] for x in froms], [x[go] for x in stored]
    return table.reshape(n, slots)


def _looked_up(place: np.ndarray, froms: list[np.ndarray], stored: list[np.ndarray]) -> np.ndarray:
    """What the permutation holds at ``place`` after the swaps so far."""
    out = place.copy()
    for where, value in zip(froms, stored):
        out = np.where(where == place, value, out)
    return out


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their rows: ``width`` words, or all words of a shorter text as one."""
    prints, n = word_prints(words), len(words.first) - 1
    doc, counts = words.doc, words.counts
    full = join_prints(prints, width)
    begin = np.flatnonzero(np.arange(len(prints)) + width <= np.repeat(words.first[1:], counts))
    keys, owner = full[begin], doc[begin]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        # Weighted sums over the words there are; the length keeps them apart from full shingles.
        weights = powers(width + 1)[1:]
        at = words.first[short]
        sums = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            there = i < counts[short]
            sums[there] += prints[at[there] + i] * weights[i]
        keys = np.concatenate([keys, mix(sums + _SLOT * counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    # Sorted by row, then key, without an argsort over keys: equal keys of a row fall together.
    tagged = mix(keys ^ mix(owner.astype(np.uint64)))
    _, at = np.unique(tagged, return_index=True)
    at.sort()
    order = at[np.argsort(owner[at], kind="stable")]
    return keys[order], owner[order]


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) fingerprints of ``rows`` slots each, different from band to band."""
    weights = powers(rows + 1)[1:]
    parts = mix(table[:, :bands * rows]).reshape(len(table), bands, rows)
    return mix((parts * weights).sum(axis=2, dtype=np.uint64) + _STEP * (1 + np.arange(bands, dtype=np.uint64)))


def fragments(table: np.ndarray) -> np.ndarray:
    """(n, slots / 8 rounded up) words of 64 bits with eight bits of each slot, to compare signatures without unpacking."""
    n, slots = table.shape
    out = np.zeros((n, -(-slots // 8) * 8), np.uint8)
    out[:, :slots] = (mix(table) >> np.uint64(40)).astype(np.uint8)
    return out.view(np.uint64)
