"""The corpus pipeline: every stage against its operator's brute force, and odd rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from newsflow.llm.store import written  # noqa: E402
from test_llm_dedup import cut, groups  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_documents(llm_spark):
    docs = llm_spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in llm_spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(llm_spark, docs, FOLDER), "stage")
        kept[name] = {r["doc_id"]: r["text"] if "text" in docs.columns else None for r in docs.collect()}
        if name != "best-fit packing":
            assert docs.columns == columns
        if name.startswith("quality"):
            good = {i for i in before if labels.get(i) == 1}
            assert len(good & set(kept[name])) >= 0.98 * len(good)
            assert sum(labels.get(i) == 0 for i in kept[name]) <= 0.02 * len(before)
        if name == "near duplicates":
            assert set(kept[name]) == {i for i, _, _, keep in groups(list(before.items()), 5, 80) if keep}
        if name == "substring dedup":
            want = {i: (gone, text) for i, n, gone, text in cut(list(before.items()), 13) if not gone or gone < n}
            assert set(kept[name]) == set(want)
            assert all(kept[name][i] == (text if gone else before[i]) for i, (gone, text) in want.items())
        if name == "best-fit packing":
            assert set(kept[name]) == set(before)


def test_odd_rows_pass_all_stages(llm_spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "text without an id " * 30, None, "s", 3, 3), (5, "a b c", "en", None, 5, 4), (5, "a b c", "en", None, 5, 4), (6, "w " * 40_000, "en", "s", 1, 5)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row.kept` int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(llm_spark, frame, FOLDER)
            assert out.columns == docs.columns or name == "best-fit packing"
            got = out.collect()
            if not frame.head(1):
                assert not got
            if name == "near duplicates" and frame.head(1):
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5", "6", "None"]


def test_columns_named_like_the_stage_s_own(llm_spark):
    same = "one two three four five six seven eight nine ten " * 5
    rows = [(1, same, i, 2, 3, 4) for i in (8, 7)] + [(2, same, 1, 2, 3, 4), (3, "other", 1, 2, 3, 4), (None, same, 1, 2, 3, 4)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, gone int, many int, count int, row int")
    out = corpus_pipeline.drop_near_duplicates(llm_spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["gone"]) for r in out.collect()) == [("1", 7), ("3", 1), ("None", 1)]


def test_rules_stage_rejects_repeaters(llm_spark, monkeypatch):
    judge = corpus_pipeline.quality_rules
    monkeypatch.setattr(corpus_pipeline, "quality_rules", lambda docs, trees, key: judge(docs, trees, key, threshold=0.0))
    rows = [(1, "buy it now " * 20), (2, "buy it now " * 3), (3, " ".join(f"word{i}" for i in range(60)))]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_rules(llm_spark, docs, FOLDER).collect()) == [2, 3]
