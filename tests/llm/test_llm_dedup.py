"""op4 and op5 against brute force."""

import random
import re

import numpy as np
import pytest

from newsflow.llm.components import components
from newsflow.llm.near_duplicates import near_duplicates
from newsflow.llm.repeats import remove_repeats
from newsflow.llm.superminhash import signatures

SCHEMA = "doc_id long, text string, key string, kept string, n_words int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "x", 7, 1) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    draw = random.Random(11)
    pool = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randint(0, 60)))) for i in range(60)]
    passage = " ".join(draw.choice(pool) for _ in range(20))
    for i in range(60, 110):
        base = rows[draw.randrange(40)][1].split()
        for _ in range(draw.randint(0, 4)):
            if base:
                base[draw.randrange(len(base))] = draw.choice(pool)
        rows.append((i, "\n".join(base) if i % 3 else " ".join(base).upper()))
    rows += [(i, f"{rows[i - 100][1]} {passage}  {rows[i - 90][1]}") for i in range(110, 118)]
    rows += [(118, None), (119, ""), (120, " \n"), (121, "w1"), (122, "W1"), (123, "w1 w1 w1 w1 w1 w1"), (124, "a b a b a b a b a b a b a b a b"), (125, "a b a b a b a b a b a b a b c")]
    draw.shuffle(rows)
    return rows


def groups(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(llm_spark, width):
    rows = corpus()
    assert {tuple(r) for r in near_duplicates(frame(llm_spark, rows), width).collect()} == groups(rows, width, 80)


def test_near_duplicates_of_a_large_group_without_hub(llm_spark):
    """A chain: each text is near its neighbours only, so no hub is near all."""
    draw = random.Random(3)
    text = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        for k in draw.sample(range(60), 2):
            text[k] = f"y{i}_{k}"
    assert {tuple(r) for r in near_duplicates(frame(llm_spark, rows), 2).collect()} == groups(rows, 2, 80)


def test_near_duplicates_odd_rows(llm_spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "d e f"), (7, "d e f"), (8, "A B  c")]
    got = sorted((tuple(r) for r in near_duplicates(frame(llm_spark, rows), 2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False), (8, 2, 3, False)], key=str)
    assert near_duplicates(frame(llm_spark, []), 2).count() == 0


def test_signatures_estimate_with_less_variance():
    draw = np.random.default_rng(5)
    seen = []
    for _ in range(150):
        a = draw.integers(0, 2**63, 100, dtype=np.uint64)
        b = np.concatenate([a[:89], draw.integers(0, 2**63, 11, dtype=np.uint64)])
        table = signatures(np.concatenate([a, b]), np.repeat([0, 1], 100), 2, 108)
        seen.append((table[0] == table[1]).mean())
    assert abs(np.mean(seen) - 89 / 111) < 0.01
    assert np.std(seen) < 0.9 * (0.8 * 0.2 / 108) ** 0.5


def test_signature_is_a_permutation_for_one_element():
    table = signatures(np.array([42], np.uint64), np.array([0]), 1, 32)
    assert sorted((table[0] >> np.uint64(48)).tolist()) == list(range(32))


def test_components_of_chains_and_loops(llm_spark):
    links = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (501, 502), (7, 7), (None, 3), (900, 900)]
    random.Random(2).shuffle(links)
    got = {tuple(r) for r in components(llm_spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {(i, 0) for i in range(1, 301)} | {(501, 500), (502, 500)}
    assert components(llm_spark.createDataFrame([], "a long, b long")).count() == 0


def cut(rows, width):
    first = {}
    texts = {i: words(t) for i, t in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - width + 1):
            first.setdefault(tuple(texts[i][k:k + width]), i)
    out = set()
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        out.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("width", [13, 4, 2])
def test_repeats_equal_brute_force(llm_spark, width):
    rows = corpus()
    found = remove_repeats(frame(llm_spark, rows), width).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found} == cut(rows, width)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in found)


def test_repeats_odd_rows(llm_spark):
    rows = [(1, None), (3, "a b c d e f"), (4, "x a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (7, "q " * 8), (8, "q q q q q q z")]
    got = {(r.row.doc_id, r.row.label, r.n_removed, r.kept) for r in remove_repeats(frame(llm_spark, rows), 5, whole_rows=True).collect()}
    assert got == {(1, 1, 0, ""), (3, 1, 0, "a b c d e f"), (4, 1, 6, "x"), (4, 1, 6, ""), (None, 1, 0, "a b c d e f"), (7, 1, 0, "q q q q q q q q"), (8, 1, 6, "z")}
    assert remove_repeats(frame(llm_spark, []), 5).count() == 0


def test_equal_windows_have_equal_symbols_in_poor_texts():
    """Few words make many runs, whose ends outside of a window must not name what is inside."""
    import pyarrow as pa

    from newsflow.llm.recompression import window_symbols
    from newsflow.llm.words import word_prints, words_of

    draw = random.Random(8)
    unequal = pairs = 0
    for _ in range(4000):
        pool = "abcdef"[:draw.randint(2, 6)]
        passage = [draw.choice(pool) for _ in range(13)]
        docs = [" ".join([draw.choice(pool) for _ in range(draw.randint(0, 8))] + passage + [draw.choice(pool) for _ in range(draw.randint(0, 8))]) for _ in range(6)]
        w = words_of(pa.array(docs))
        prints = word_prints(w)
        symbols = window_symbols(w, prints, 13)
        seen = {}
        for i, text in enumerate(docs):
            own = text.split()
            for k in range(len(own) - 12):
                key = tuple(own[k:k + 13])
                symbol = symbols[w.first[i] + k]
                unequal += seen.setdefault(key, symbol) != symbol
                pairs += 1
    assert pairs > 100_000 and not unequal


def removed(rows, width=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            first[tuple(w[k:k + width])] = min(i, first.get(tuple(w[k:k + width]), i))
    out = set()
    for i, text in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < i for j in range(width)}
        out.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_poor_texts_equal_brute_force(llm_spark):
    rows = [(1, "c z d d c a b a b a b a c a c c a"), (2, "b c z b b a c a d d c a b a b a b a c a c z c d b z b b d b b")]
    draw = random.Random(3)
    # Each group of documents has words of its own, so one table holds two hundred small ones.
    for group in range(200):
        pool = [f"{c}{group}" for c in "abcdef"[:draw.randint(2, 6)]]
        rows += [(10 + group * 5 + i, " ".join(draw.choice(pool) for _ in range(draw.randint(10, 40)))) for i in range(5)]
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(frame(llm_spark, rows)).collect()}
    assert got == removed(rows)
    assert {r[0]: r[2] for r in got}[2] == 13
