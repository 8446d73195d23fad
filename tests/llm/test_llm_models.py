"""op8 and op10: exact counts, held-out accuracy, constraints, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsflow.llm import quality_queries
from newsflow.llm.boosted import MONOTONE, fit_quality_rules, fit_trees, quality_rules
from newsflow.llm.pairwise import fit_quality, fit_strengths, quality_scores
from newsflow.llm.text_stats import SHAPES


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_rules_count_like_brute_force(llm_spark, small):
    docs = {r["doc_id"]: r["text"] for r in llm_spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = quality_queries.quality_rules_query(llm_spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(docs[r["doc_id"]])
        assert r["kept"] == (r["verdict"] and not r["base_failed"])


def test_held_out_accuracy(llm_spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in llm_spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ranked = quality_queries.quality_ranking(llm_spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in ranked)
    held = [r for r in ranked if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    ruled = [r for r in quality_queries.quality_rules_query(llm_spark, folder).collect() if r["doc_id"] in {h["doc_id"] for h in held}]
    assert np.mean([r["verdict"] == labels[r["doc_id"]] for r in ruled]) > 0.95


ROWS = [(1, None), (2, ""), (3, "!"), (None, "words " * 60), (4, "a\n" * 400), (4, "\x00� é"), (5, "x" * 300_000)]


def test_odd_rows_and_empty_tables(llm_spark):
    docs = llm_spark.createDataFrame([(i, t, True, 0.5, 3) for i, t in ROWS], "doc_id long, text string, kept boolean, score double, key int")
    labels = llm_spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (5, 7), (4, 1)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        scored = quality_scores(docs, fit_quality(docs, own)).collect()
        assert sorted(map(str, (r["doc_id"] for r in scored))) == sorted(str(i) for i, _ in ROWS)
        ruled = quality_rules(docs, fit_quality_rules(docs, own)).collect()
        assert {(r["doc_id"], r["n_words"]) for r in ruled} == {(i, counts(t)[0]) for i, t in ROWS}
    assert quality_scores(docs.limit(0), fit_quality(docs, labels)).count() == 0
    assert all(r["kept"] or r["base_failed"] for r in quality_rules(docs, fit_quality_rules(docs, labels.limit(0))).collect())


def test_trees_are_monotone_and_accurate():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.5 * np.sin(3 * x[:, 2])) > 0).astype(float)
    trees = fit_trees(x, y, np.array([1, -1, 0]))
    assert np.mean((trees.probability(x) > 0.5) == y) > 0.95
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:40], 60, axis=0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 60), 40)
        steps = np.diff(trees.margin(grid).reshape(40, 60), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert set(MONOTONE) <= set(SHAPES)


def test_flat_trees_equal_walking_the_nodes():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 4))
    trees = fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), np.zeros(4))
    for row in x[:50]:
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert trees.margin(row[None])[0] == pytest.approx(total)


def test_strengths_order_pairs():
    from newsflow.llm.pairwise import SIZE
    draw = np.random.default_rng(4)
    x = draw.normal(size=(800, SIZE)).astype(np.float32)
    y = (x[:, 0] > 0.3).astype(int)
    model = fit_strengths(x, y)
    score = model.score(x)
    assert np.mean((score >= 0.5) == y) > 0.9
    assert (score >= 0.5).mean() == pytest.approx(y.mean(), abs=0.01)  # the quantile of the poor share


def test_a_labelled_id_counts_once(llm_spark):
    from newsflow.llm.labelled import HELD_OUT, fold, labelled_texts
    learned = [r[0] for r in llm_spark.range(100).filter(fold("id") != HELD_OUT).limit(3).collect()]
    docs = llm_spark.createDataFrame([(learned[0], f"text {n}") for n in range(500, 0, -1)] + [(learned[1], None), (learned[1], "b"), (learned[2], None)], "doc_id long, text string")
    labels = llm_spark.createDataFrame([(i, 1) for i in learned], "doc_id long, quality int")
    assert sorted(map(str, labelled_texts(docs, labels, 10).collect())) == sorted(f"Row(text={t!r}, label=1)" for t in ("text 1", "b", None))
