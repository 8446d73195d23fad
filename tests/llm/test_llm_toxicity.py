"""op11: derivatives, held-out accuracy, windows, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from newsflow.llm import quality_queries
from newsflow.llm import recurrent as module
from newsflow.llm.recurrent import Network, best_cut, fit_network, forms_of, united, window_starts
from newsflow.llm.toxicity import fit_toxicity, toxicity_scores

TEXTS = ["the cat sat on the mat " * 4, "", "a bad bad dog", None, "Ünï côde!! 12 x"]


def column(texts):
    return pa.array(texts, pa.large_string())


def test_derivatives_equal_differences():
    forms = forms_of(column(TEXTS))
    starts, row = window_starts(forms.first)
    ends = forms.first[row + 1]
    net = Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    local, some = net.local(forms, starts, ends)
    x, lost = net.inputs(some), np.random.default_rng(0).normal(size=len(starts))
    inward = net.parts(x)[:, local]
    g = net.gradients(inward, local, some, x, lost, net.run(inward, keep=True)[1])
    draw = np.random.default_rng(1)
    for name, value in net.p.items():
        strong = np.argwhere(np.abs(g[name]) >= np.abs(g[name]).max() / 10)
        at = tuple(strong[draw.integers(len(strong))])
        before, sums = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = before + step
            sums.append(float((net.logits(forms, starts, ends) * lost).sum()))
        value[at] = before
        assert g[name][at] == pytest.approx((sums[0] - sums[1]) / 2e-3, rel=2e-2)


def test_windows_cover_and_overlap():
    for n in (0, 1, 16, 17, 24, 25, 500):
        starts, _ = window_starts(np.array([0, n]))
        covered = [i for s in starts for i in range(s, min(s + module.WIDTH, n))]
        assert set(covered) == set(range(n)) and len(starts) >= 1
        assert all(b - a == module.STEP for a, b in zip(starts, starts[1:]))


def test_slices_and_blocks_change_nothing():
    texts = column(TEXTS)
    whole, parts = forms_of(texts), united([forms_of(texts.slice(a, n)) for a, n in ((0, 2), (2, 1), (3, 2))])
    assert parts.first.tolist() == whole.first.tolist()
    starts, row = window_starts(whole.first)
    ends = whole.first[row + 1]
    net = Network()
    assert np.allclose(net.logits(whole, starts, ends), net.logits(parts, starts, ends, block=1), atol=1e-5)


def test_finds_words_in_long_texts():
    draw = np.random.default_rng(2)
    pool = [f"{a}{b}" for a in ("an", "er", "th", "on") for b in ("ea", "ly", "or", "ti")]
    texts, label = [], []
    for i in range(240):
        words = list(draw.choice(pool, int(draw.integers(5, 200))))
        if i % 3 == 0:
            words[int(draw.integers(len(words)))] = "scumling,"
        texts.append(" ".join(words))
        label.append(int(i % 3 == 0))
    net = fit_network(column(texts), np.array(label))
    score, windows, worst = net.texts(column(texts))
    assert np.mean((score >= 0.5) == np.array(label)) > 0.97
    hits = [i for i in range(240) if label[i]]
    assert np.mean(["scumling," in texts[i].split()[worst[i]:worst[i] + module.WIDTH] for i in hits]) > 0.95


def test_held_out_accuracy(llm_spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in llm_spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality_queries.toxicity_windows(llm_spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1])
    false = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 0])
    assert caught > 0.85 and false < 0.03


def test_odd_rows(llm_spark):
    rows = [(1, None), (2, ""), (3, "!?"), (None, "words " * 60), (4, "a\n" * 400), (4, "\x00� é"), (5, "x" * 300_000)]
    docs = llm_spark.createDataFrame([(i, t, 0.5, 3, 1) for i, t in rows], "doc_id long, text string, score double, key int, n_windows int")
    labels = llm_spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (5, 7), (4, 1)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        scored = toxicity_scores(docs, fit_toxicity(docs, own)).collect()
        assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 and r["n_windows"] >= 1 for r in scored)
    assert toxicity_scores(docs.limit(0), fit_toxicity(docs.limit(0), labels)).count() == 0


def test_cut_separates():
    assert best_cut(np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) == 2.5
