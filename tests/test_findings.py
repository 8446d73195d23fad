"""Queries on tables as they come at size: folders of files, repeated addresses, long pages, many vectors."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.operators import clustering, history, model, neardup, ranking, vectors
from newsflow.plans import load_queries

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = load_queries()


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def agrees(spark, folder, name):
    """The query on ``folder`` equals its SQL there."""
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{files}'")
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, str(folder))
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told(columns, cursor.fetchall())


def test_stream_of_a_table_in_several_files(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    agrees(spark, tmp_path, "stream_unseen")


def test_history_of_repeated_addresses(spark, tmp_path):
    rows = [(i, f"https://a.example/{i % 7}?x={i}", "") for i in range(1, 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    agrees(spark, tmp_path, "history_write")


def test_text_of_odd_references_and_long_pages(spark, tmp_path):
    odd = ["&amp", "&ampx;", "&&&amp", "&amp;lt;", "&quot", "&quot;", "&am", "&a", "&", "&#65;", "&#x41", "&#128;", "&#0;", "&#55555;", "&#1;", "&#99999999999;", "&eacute;", "&eacutex",
           "&notin;", "&notit;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&lt;b&gt;", "&nosuch;", "&copy;&middot;"]
    pages = [(i, "u", f"<title>t {x}</title><body><p>a{x}b</p><p>{x} end</p></body>") for i, x in enumerate(odd)]
    pages += [(100, "u", "<p>" + "word " * 9000 + "</p><p>last  one</p>"), (101, "u", ""), (102, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    agrees(spark, tmp_path, "html_text")
    whole = {r["page_id"]: r["page_text"] for r in QUERIES["html_text"](spark, str(tmp_path)).collect()}[100]
    assert whole.endswith("\nlast one")


class _Frame:
    """Stands for a frame whose rows are mapped: gives the mapping function back."""

    def select(self, *columns):
        return self

    def mapInPandas(self, function, schema):
        return function


def test_rows_that_visit_many_cells_leave_in_pieces(spark):
    pivots = np.random.default_rng(1).normal(size=(200, 8))
    vecs = list(np.random.default_rng(2).normal(size=(3000, 8)))
    visit = vectors.assign_cells(_Frame(), pivots, "vid long, vec array<double>", float("inf"))
    out = list(visit(iter([pd.DataFrame({"vid": range(3000), "vec": vecs, "_radius": np.inf})])))
    assert sum(map(len, out)) == 3000 * 200 and max(map(len, out)) <= 4096


def test_blocks_meet_once_and_whole(spark):
    """More rows than a tile has: every pair of tiles comes, symmetric ones once."""
    rows = spark.range(5000).select(F.col("id").alias("vid"), F.array(F.rand(3)).alias("vec"), F.lit(0).alias("cell"))

    def count(home, probe):
        same = len(home) == len(probe) and home["vid"].iloc[0] == probe["vid"].iloc[0]
        return pd.DataFrame({"n": [len(home) * (len(home) - 1) // 2 if same else len(home) * len(probe)]})

    rows = rows.localCheckpoint()
    once = vectors.compare_blocks(rows, rows, count, "n long", symmetric=True).agg(F.sum("n")).first()[0]
    assert once == 5000 * 4999 // 2


@pytest.mark.parametrize("name", ["neardup_losers", "dupe_marks_similar"])
def test_best_rows_are_found_without_pairs(spark, small, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(neardup, "_distinct_pairs", refuse)
    agrees(spark, small, name)


def test_pairs_leave_a_few_rows_at_a_time(spark, monkeypatch):
    kept = []
    blocks = vectors.compare_blocks
    monkeypatch.setattr(vectors, "compare_blocks", lambda homes, probes, compare, *a, **k: kept.append(compare) or blocks(homes, probes, compare, *a, **k))
    rows = spark.range(3).select(F.col("id").alias("vid"), F.array(F.lit(1.0), F.col("id") * 0.0).alias("vec"))
    neardup._distinct_pairs(rows, 0.5)
    tile = pd.DataFrame({"vid": range(2048), "vec": list(np.ones((2048, 2))), "cell": 0, "home": 0})
    out = list(kept[0](tile, tile))
    assert sum(map(len, out)) == 2048 * 2047 // 2 and max(map(len, out)) <= 128 * 2048


def test_silhouette_of_many_small_and_a_large_cluster(spark, monkeypatch):
    """What leaves the blocks is a few rows per row, not one per row and cluster."""
    left = []
    blocks = vectors.compare_blocks
    monkeypatch.setattr(vectors, "compare_blocks", lambda *a, **k: left.append(blocks(*a, **k)) or left[-1])
    n = 4000
    x = np.random.default_rng(5).normal(size=(n, 3))
    label = np.where(np.arange(n) < 2500, 0, np.arange(n) // 2)
    frame = pd.DataFrame({"vid": range(n), "vec": list(x), "labels": [[int(v)] for v in label]})
    rows = spark.createDataFrame(frame, "vid long, vec array<double>, labels array<long>")
    got = clustering.silhouettes(rows, 1).first()["silhouette"]
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    names, codes, counts = np.unique(label, return_inverse=True, return_counts=True)
    total = dist @ np.eye(len(names))[codes]
    own = codes[:, None] == np.arange(len(names))
    a, b = (total / (counts - 1))[own], np.where(own, np.inf, total / counts).min(axis=1)
    assert abs(got - ((b - a) / np.maximum(a, b)).mean()) < 1e-7
    assert left[0].count() <= 20 * n


def test_near_texts_meet_family_by_family(spark, monkeypatch):
    """Pairs travel as ids, not with their texts, and a family's come to few tasks."""
    asked, sent = set(), []
    confirmed = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda met, *a: asked.update(tuple(r) for r in met.collect()) or confirmed(met, *a))
    written = neardup.cut_lineage
    monkeypatch.setattr(neardup, "cut_lineage", lambda df: sent.append(written(df)) or sent[-1])
    monkeypatch.setattr(neardup, "FREQUENT_TERMS", 5)
    monkeypatch.setattr(neardup, "_PAIRS", 4)
    draw = np.random.default_rng(8)
    rows = [f"rare{i // 10} " + " ".join(f"w{x}" for x in draw.integers(0, 400, 40)) for i in range(100)]
    family = " ".join(f"v{x}" for x in range(60))
    rows += [f"{family} w{x}" for x in range(12)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(rows)], "id long, text string, content_length long")
    kept = {r["id"] for r in neardup.drop_near_texts(df, threshold=0.925).collect()}
    assert set(range(100)) <= kept and kept - set(range(100)) == {111}
    assert asked >= {(a, b) for a in range(100, 112) for b in range(a + 1, 112)}
    tiles = [df for df in sent if "tile" in df.columns]
    assert len(tiles) == 1 and set(tiles[0].columns) == {"tile", "cid", "other"} and tiles[0].count() == len(asked)


def test_strengths_are_fitted_in_packed_cells(spark, monkeypatch):
    """Steps write a row per block, whatever the pairs; self-battles and strangers count as before."""
    kept = []
    written = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: kept.append(written(df)) or kept[-1])
    monkeypatch.setattr(ranking, "EDGES", 60)
    draw = np.random.default_rng(4)
    battles = [tuple(map(int, draw.integers(0, 70, 2) * 3)) for _ in range(900)]
    ids = [3 * i for i in range(2, 75)]  # 0 and 3 are strangers, the last have no battle
    start = {i: float(draw.normal()) for i in ids[::2]}
    w = {i: float(np.exp(start.get(i, 0.0))) for i in ids}
    wins = {i: sum(a == i != b for a, b in battles) for i in ids}
    for _ in range(3):
        d = dict.fromkeys(ids, 0.0)
        for a, b in battles:
            if a != b and a in w and b in w:
                d[a] += 1 / (w[a] + w[b])
                d[b] += 1 / (w[a] + w[b])
        w = {i: (wins[i] + 0.05) / (d[i] + 0.1 / (w[i] + 1)) for i in ids}
    mean = np.mean(np.log(list(w.values())))
    out = ranking.bradley_terry(
        spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(battles, "winner long, loser long"), iterations=3,
        start=spark.createDataFrame(list(start.items()), "id long, bt double"))
    got = {r["id"]: r["bt"] for r in out.collect()}
    assert set(got) == set(ids) and all(abs(got[i] - (np.log(w[i]) - mean)) < 1e-9 for i in ids)
    steps = [df for df in kept if df.columns == ["block", "wins", "w"]]
    assert len(steps) == 3 and all(df.count() <= 6 for df in steps)


def test_summary_weights_of_frequent_words_are_added_in_place(spark, monkeypatch):
    """One row per sentence leaves the split, with the words that still need their weight."""
    kept = []
    written = model.cut_lineage
    monkeypatch.setattr(model, "cut_lineage", lambda df: kept.append(written(df)) or kept[-1])
    monkeypatch.setattr(model, "FREQUENT", 0.05)
    texts = [(i, f"Common words here, only{i} is rare. ... Common again!\n!!! common only{i // 2}") for i in range(20)]
    out = model.extract_summary(spark.createDataFrame(texts + [(20, None), (21, "")], "id long, text string"), "id", "text").collect()
    sums = [df for df in kept if "open" in df.columns]
    assert len(sums) == 1 and sums[0].count() == 60
    assert all(w.startswith("only") for r in sums[0].collect() for w in r["open"])
    assert len(out) == 60 and {r["sentence"] for r in out if r["id"] == 4} == {"Common words here, only4 is rare.", "Common again!", "common only2"}


def test_addresses_are_cut_only_into_pieces_asked_for(spark):
    """With long domains only, a URL gives its pieces of eight; a hot title streams its history past the few domains."""
    past = spark.createDataFrame([(f"https://www.long-name.example/{i}", "", "t", i) for i in range(40)], "final_url string, initial_url string, title string, n long")
    past = past.withColumn("created_at", F.timestamp_seconds("n")).drop("n")
    pairs = spark.createDataFrame([("t", "long-name.example"), ("t", "other-name.example"), ("u", "long-name.example")], "title string, _domain string")
    found = history._title_domain_matches(pairs, past)
    assert [(r["title"], r["_domain"], r["_m_at"].second) for r in found.collect()] == [("t", "long-name.example", 39)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "lambda" in plan and plan.count("transform(") == 1
    short = pairs.select("title", F.explode(F.array(*map(F.lit, ["g", "am", "exa", "name", "ww.lon", "zz"]))).alias("_domain"))
    assert {r["_domain"] for r in history._title_domain_matches(short, past).collect()} == {"g", "am", "exa", "name", "ww.lon"}


def test_short_words_are_encoded_at_once_with_patterns_made_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from newsflow.llm import transducer

    tokenizer = transducer.BytePairTokenizer(public_tokenizers.path("word_bpe_49k.json"))

    def refuse(*_):
        raise AssertionError("a pattern is looked up per text")

    monkeypatch.setattr(transducer.regex, "sub", refuse)
    machine = tokenizer.transducer
    for word in ["a", "newsletter", "x" * 2 * machine.lookahead, "ab" * machine.lookahead]:
        letters = [tokenizer.letters[b] for b in word.encode()]
        assert machine.short(letters) == list(machine(iter(letters)))
    long = "abc" * machine.lookahead
    assert list(tokenizer.stream(f"  One  {long}\nword")) == [i for t in ("One", long, "word") for i in tokenizer.stream(t)]


def broadcast_rows(spark, run):
    """Rows of each broadcast of the executions in ``run``, as their final plans count them."""
    def listed(seq):
        return [seq.apply(i) for i in range(seq.size())]

    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    last = max([e.executionId() for e in listed(store.executionsList())], default=-1)
    run()
    bus.waitUntilEmpty()
    rows = []
    for e in [e.executionId() for e in listed(store.executionsList()) if e.executionId() > last]:
        values = store.executionMetrics(e)
        for node in listed(store.planGraph(e).allNodes()):
            if node.name().startswith("BroadcastExchange"):
                ids = [m.accumulatorId() for m in listed(node.metrics()) if m.name() == "number of output rows"]
                rows += [int(values.apply(i).replace(",", "")) for i in ids if values.contains(i)]
    return rows


def test_a_tournament_sends_no_table_to_the_driver(spark, small):
    """Broadcasts hold a row per partition or window, not per item; the shared steps have none."""
    n = 400
    scores = spark.createDataFrame([(i, float(i * 7 % n)) for i in range(n)], "id long, score double").localCheckpoint()

    def play():
        out = ranking.tournament(scores.select("id"), lambda s: ranking.judge_by_score(s, scores, "id", "score"), rounds=2, iterations=2)
        assert out.count() == n

    sent = broadcast_rows(spark, play)
    assert sent and max(sent) <= 50
    assert broadcast_rows(spark, lambda: QUERIES["battle_pairs"](spark, small).collect()) == []
    assert broadcast_rows(spark, lambda: ranking.rank_change(scores, scores, "id", "score").collect()) == []


def test_strengths_do_not_hang_on_the_order_of_sums(spark, monkeypatch):
    """The same bits for any number of partitions, so that ties break alike in every run."""
    monkeypatch.setattr(ranking, "EDGES", 40)
    draw = np.random.default_rng(6)
    items = spark.range(300).localCheckpoint()
    battles = spark.createDataFrame([tuple(map(int, draw.integers(0, 300, 2))) for _ in range(2000)], "winner long, loser long").localCheckpoint()
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    fits = []
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            fits.append({r["id"]: r["bt"] for r in ranking.bradley_terry(items, battles, iterations=3).collect()})
    finally:
        for name, value in settings.items():
            spark.conf.set(name, value)
    assert fits[0] == fits[1]


def _cloud(n, dims, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    x[: n // 3] = x[n // 3: n // 3 + 5][draw.integers(5, size=n // 3)] + draw.normal(size=(n // 3, dims)) * 1e-4  # families of near copies
    return x + 5


def test_nearest_lists_in_parts_are_exact(spark, monkeypatch):
    from newsflow.operators import meetings

    for name, value in (("PROBES", 100), ("PAIRS", 9000), ("_TILE", 16), ("_WIDE", 40)):
        monkeypatch.setattr(meetings, name, value)
    x = _cloud(300, 6, 1)
    label = np.arange(300) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    rows = spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(x)], "vid long, vec array<double>, label long").repartition(3)
    for within in (None, "label"):
        told = d if within is None else np.where(label[:, None] == label[None, :], d, np.inf)
        got = {r["vid"]: [e["other"] for e in r["near"]] for r in meetings.nearest_lists(rows, 7, within).collect()}
        assert got == {i: np.argsort(told[i], kind="stable")[:7].tolist() for i in range(300)}


def test_tree_of_short_lists_is_the_whole_graphs(spark, monkeypatch):
    """Lists that end inside of every family leave parts that must search; weights as by Prim's on the matrix."""
    from newsflow.operators import hierarchy, meetings

    monkeypatch.setattr(meetings, "_TILE", 32)
    x = _cloud(240, 5, 2)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    core = np.sort(d, axis=1)[:, 3]
    label = np.arange(240) % 2
    rows = [(i, v.tolist(), [0.0, float(core[i])], int(label[i])) for i, v in enumerate(x)]
    cored = spark.createDataFrame(rows, "vid long, vec array<double>, cores array<double>, label long")
    for bound in (hierarchy.BOUND, 20):
        monkeypatch.setattr(hierarchy, "BOUND", bound)
        for within in (None, "label"):
            got = hierarchy.spanning_tree(cored, 2, within=within, k=3).collect()
            for run, c in enumerate((np.zeros(240), core)):
                w = np.maximum(np.maximum(d, c[:, None]), c[None])
                if within:
                    w[label[:, None] != label[None, :]] = np.inf
                assert sorted(r["w"] for r in got if r["run"] == run) == sorted(e[2] for e in hierarchy._tree(w, True))


def test_separations_beyond_the_lists(spark):
    from newsflow.operators import hierarchy, meetings

    x = _cloud(200, 4, 3)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    core = np.sort(d, axis=1)[:, 2]
    labels = [[int(v) if v >= 0 else None for v in row] for row in np.stack([np.where(x[:, 0] > 5, 1, 2), np.arange(200) % 4 - 1], axis=1)]
    rows = spark.createDataFrame([(i, v.tolist(), [0.0, float(core[i])], labels[i]) for i, v in enumerate(x)], "vid long, vec array<double>, cores array<double>, labels array<long>")
    lists = meetings.nearest_lists(rows, 2)
    got = {(r["trial"], r["label"]): r["apart"] for r in clustering.separations(rows, [1, 0], lists, 2).collect()}
    want = {}
    for t, c in enumerate((core, np.zeros(200))):
        w = np.maximum(np.maximum(d, c[:, None]), c[None])
        own = np.array([-1 if v[t] is None else v[t] for v in labels])
        for k in set(own) - {-1}:
            want[t, k] = w[np.ix_(own == k, (own != k) & (own >= 0))].min()
    assert got == want


def test_silhouettes_of_a_family_equal_single_trials(spark, monkeypatch):
    x = _cloud(180, 3, 4)
    # Clusters lie in each other or apart, and are named by their first row.
    labels = [[i // 60 * 60, i // 20 * 20 if i // 20 % 4 else None, i // 5 * 5 if i % 7 or i % 5 else None] for i in range(180)]
    labels = [[v if v is None or t < 2 else min(j for j in range(v, v + 5) if labels[j][2] is not None) for t, v in enumerate(row)] for row in labels]
    rows = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vid long, vec array<double>, labels array<long>")
    told = [{r["trial"]: r["silhouette"] for r in clustering.silhouettes(rows, 3, families).collect()} for families in (None, [[0, 1, 2]])]
    monkeypatch.setattr(vectors, "CHUNK", 25)
    told.append({r["trial"]: r["silhouette"] for r in clustering.silhouettes(rows, 3, [[0, 1, 2]]).collect()})
    assert told[1] == pytest.approx(told[0], abs=1e-12) and told[2] == pytest.approx(told[0], abs=1e-12)


def test_near_texts_leave_few_tables_and_no_shuffle_files(spark):
    """What a step has read goes when the next table stands: lists of terms, term numbers and meeting terms."""
    from newsflow.session import shared_dir

    folder = f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    there = set(glob.glob(f"{folder}/*"))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 20:i % 20 + 30] + [f"own{i // 20}"] * (i % 3)), 100 + i % 7) for i in range(200)]
    left = neardup.drop_near_texts(spark.createDataFrame(rows, "id long, text string, content_length long"), threshold=0.9)
    assert 0 < left.count() < 200
    assert len(set(glob.glob(f"{folder}/*")) - there) == 5


def test_tables_are_written_without_leaving_shuffle_files(spark):
    from newsflow.session import cut_lineage, drop_table

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(blocks.apply(i).getName()) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i).getName())}

    before = files()
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), tidy=True)
    assert not files() - before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    drop_table(table)
    assert not os.path.exists(table.path.removeprefix("file:"))
