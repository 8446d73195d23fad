"""Hand-computed cases and invariants of the operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.operators import clustering, dedup, edits, evaluate, history, mmr, model, neardup, numbering, ranking, stats, vectors
from newsflow.sources import catalog, html, sinks, tables


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_best_copy(spark):
    df = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, "u", 9)], "id long, final_url string, content_length long")
    assert ids(dedup.first_per_key(df, ["final_url"], [F.desc("content_length"), "id"])) == [2]


def test_first_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = dedup.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_numbering_matches_a_sort(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("v"), F.lit("g").alias("g"))
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r["v"], r["id"])))}
    assert {r["id"]: r["n"] for r in numbering.number_rows(df, [F.desc("v"), "id"], "n").collect()} == want
    # One group holds every row and spans several partitions.
    assert {r["id"]: r["n"] for r in numbering.number_within(df, ["g"], [F.desc("v"), "id"], "n").collect()} == want


HISTORY = "initial_url string, final_url string, title string, source string, created_at timestamp"


@pytest.mark.parametrize("since,kept", [(None, []), ("2025-01-01 09:00:00", [1]), ("2025-01-01 11:00:00", [])])
def test_history_cutoff(spark, since, kept):
    items = spark.createDataFrame([(1, "u1", "s", "t")], "id long, url string, source string, title string")
    past = spark.sql("select 'u1' initial_url, '' final_url, 'x' title, 'y' source, timestamp'2025-01-01 10:00:00' created_at")
    limit = None if since is None else F.to_timestamp(F.lit(since))
    assert ids(history.unseen_items(items, past, limit)) == kept


def test_history_by_title_and_blank_url(spark):
    items = spark.createDataFrame(
        [(1, "new", "s", "t"), (2, "", "s", "t"), (3, "new3", "s", "other"), (4, None, "s", "t")], "id long, url string, source string, title string")
    past = spark.sql("select 'u1' initial_url, '' final_url, 't' title, 's' source, timestamp'2025-01-01 10:00:00' created_at")
    assert ids(history.unseen_items(items, past)) == [2, 3, 4]


def test_history_with_a_hot_key(spark):
    items = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
                                     F.lit("s").alias("source"), F.col("id").cast("string").alias("title"))
    past = spark.sql("select 'hot' initial_url, '' final_url, 'x' title, 'y' source, timestamp'2025-01-01 10:00:00' created_at")
    assert history.unseen_items(items, past).count() == 1000


def test_history_after_redirect(spark):
    items = spark.createDataFrame(
        [(1, "https://www.bbc.co.uk/a", "T"), (2, "https://x.example.com/b", "T"), (3, "", "T"), (4, "https://f.example.org/", "Q")],
        "id long, final_url string, title string")
    past = spark.sql("""select 'http://BBC.co.uk/zz' initial_url, '' final_url, 'T' title, 's' source, timestamp'2025-01-01' created_at
                        union all select 'i', 'https://f.example.org/', 'W', 's', timestamp'2025-01-01'""")
    assert ids(history.unseen_after_redirect(items, past)) == [2, 3]


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, created long")
    new = spark.createDataFrame([("a", 5, 99), ("a", 4, 98), ("c", 6, 97)], "k string, v long, created long")
    out = sinks.upsert(old, new, ["k"], [F.desc("created")], keep=["created"])
    assert sorted(map(tuple, out.collect())) == [("a", 5, 10), ("b", 2, 20), ("c", 6, 97)]


def test_history_rows_fall_back_to_the_address(spark):
    gathered = spark.createDataFrame([("u1", "t", "s", True), ("u2", "t", "s", None), ("u3", "t", "s", True)], "url string, title string, source string, isAI boolean")
    done = spark.createDataFrame([("u1", "f1"), ("u2", "")], "url string, final_url string")
    out = sinks.history_rows(gathered, done, F.to_timestamp(F.lit("2025-01-01")))
    assert {r["initial_url"]: (r["final_url"], r["isAI"]) for r in out.collect()} == {"u1": ("f1", True), "u2": ("u2", False), "u3": ("", True)}


def brute_near(rows, threshold):
    """Losers by looking at every pair in order."""
    lost = set()
    for i, (a, la, va) in enumerate(rows):
        for b, lb, vb in rows[i + 1:]:
            if np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) > threshold:
                lost.add(b if la is not None and lb is not None and la > lb else a)
    return lost


def test_near_duplicates_small(spark):
    df = spark.createDataFrame([(1, 100), (2, 100), (3, 50), (4, 1)], "id long, content_length long")
    c = math.cos(0.3), math.sin(0.3)
    d = math.cos(0.6), math.sin(0.6)
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, list(c)), (3, list(d))], "id long, embedding array<double>")
    assert ids(neardup.drop_near_duplicates(df, emb, threshold=0.95)) == [2, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)  # several cells and chunks
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    vecs = [centres[i % 6] + rng.normal(scale=0.15, size=5) for i in range(150)]
    vecs += [vecs[3]] * 40 + [vecs[9]] * 10  # a large group of copies
    lens = [None if i % 9 == 0 else int(rng.integers(1, 6)) for i in range(len(vecs))]
    rows = [(i, lens[i], np.array(v)) for i, v in enumerate(vecs)]
    df = spark.createDataFrame([(i, l) for i, l, _ in rows], "id long, content_length long")
    emb = spark.createDataFrame([(i, v.tolist()) for i, _, v in rows], "id long, embedding array<double>")
    want = set(range(len(rows))) - brute_near(rows, 0.95)
    assert set(ids(neardup.drop_near_duplicates(df, emb, threshold=0.95))) == want
    pairs = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(emb.filter("id < 150"), "id", "embedding", 0.95).collect()}
    unit = [v / np.linalg.norm(v) for v in vecs[:150]]
    assert pairs == {(i, j) for i in range(150) for j in range(i + 1, 150) if unit[i] @ unit[j] > 0.95}


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    merged = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vid long, vec array<double>, copies long")
    got = clustering.nearest_neighbours(merged, 4).collect()
    near = {}
    for r in got:
        near.setdefault(r["vid"], set()).add(r["other"])
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    assert near == {i: set(np.argsort(dist[i])[:4].tolist()) for i in range(120)}


def brute_mmr(rows, n, weight):
    lo, hi = min(r for _, r, _ in rows), max(r for _, r, _ in rows)
    unit = {i: v / np.linalg.norm(v) for i, _, v in rows}
    rel = {i: (r - lo) / (hi - lo) for i, r, _ in rows}
    picks = [min(rows, key=lambda t: (-t[1], t[0]))[0]]
    while len(picks) < n:
        left = [i for i, _, _ in rows if i not in picks]
        picks.append(min(left, key=lambda i: (-(weight * rel[i] + (1 - weight) * (1 - max(unit[i] @ unit[p] for p in picks))), i)))
    return picks


def test_mmr(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 5.0)], "id long, rating double")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    assert ids(mmr.mmr_select(df, emb, 2)) == [1, 3]
    assert mmr.mmr_select(df, emb, 0).count() == 0
    assert mmr.mmr_select(df, emb, 5).count() == 3


@pytest.mark.parametrize("pool", [1, 4, 64])
def test_mmr_pools_do_not_change_the_result(spark, pool):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 50)), rng.normal(size=4)) for i in range(60)]
    df = spark.createDataFrame([(i, r) for i, r, _ in rows], "id long, rating double")
    emb = spark.createDataFrame([(i, v.tolist()) for i, _, v in rows], "id long, embedding array<double>")
    got = {r["pick"]: r["id"] for r in mmr.mmr_select(df, emb, 12, 0.5, pool=pool).collect()}
    assert [got[i] for i in range(12)] == brute_mmr(rows, 12, 0.5)


def test_swiss_pairs_and_batches(spark):
    ranked = spark.createDataFrame(
        [(1, 0, 1, [2]), (2, 0, 2, [1]), (3, 0, 3, []), (4, 0, 4, []), (5, 0, 5, [])], "id long, pool long, rank long, fought array<long>")
    pairs = ranking.swiss_pairs(ranked)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 3), (2, 4)]
    one = ranking.batches(ranked, pairs, size=6).orderBy("batch", "pos").collect()
    assert [r["id"] for r in one] == [1, 3, 2, 4, 5]
    two = ranking.batches(ranked, pairs, size=2).orderBy("batch", "pos").collect()
    assert [r["id"] for r in two] == [1, 3, 2, 4]


@pytest.mark.parametrize("n,seed", [(61, 1), (1001, 2)])
def test_pairs_do_not_depend_on_windows(spark, n, seed):
    draw = np.random.default_rng(seed)
    met = [set() for _ in range(n)]
    for i in range(n):
        # Mostly close ranks have met, some items nearly everyone around.
        for j in {int(x) for x in i + draw.integers(1, 9, size=10 if i % 17 == 3 else 2)} - {i}:
            if j < n:
                met[i].add(j)
                met[j].add(i)
    free, want = list(range(n)), []
    while free:
        i = free.pop(0)
        j = next((j for j in free if j not in met[i]), None)
        if j is not None:
            free.remove(j)
            want.append((i, j))
    for window in (10, n + 1):
        rows = [(i, i // window, i + 1, sorted(met[i])) for i in range(n)]
        ranked = spark.createDataFrame(rows, "id long, pool long, rank long, fought array<long>")
        pairs = ranking.swiss_pairs(ranked)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)
    seated = ranking.batches(ranked, pairs).collect()
    assert sorted(r["id"] for r in seated) == list(range(n)) if n % 6 != 1 else len(seated) == n - 1


def test_battle_results(spark):
    placed = spark.createDataFrame([(0, 7, 1), (0, 3, 2), (0, 9, 3)], "batch long, id long, place long")
    got = ranking.battle_results(placed, ["batch"])
    assert sorted((r["winner"], r["loser"]) for r in got.collect()) == [(3, 9), (7, 3), (7, 9)]


def test_bradley_terry_orders_items_and_improves(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "id long")
    battles = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 2), (2, 1), (1, 2), (0, 2), (2, 3)], "winner long, loser long")
    fits = [ranking.bradley_terry(items, battles, iterations=n) for n in (1, 12)]
    likelihood = [ranking.log_likelihood(f, battles).first()[0] for f in fits]
    assert likelihood[1] >= likelihood[0]
    assert [r["id"] for r in fits[1].orderBy(F.desc("bt")).collect()] == [0, 1, 2, 3]


def test_tournament_finds_the_best(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(14)], "id long, score double")
    out = ranking.tournament(scores.select("id"), lambda s: ranking.judge_by_score(s, scores, "id", "score"), rounds=2, iterations=8)
    best = out.orderBy(F.desc("bt")).first()["id"]
    assert out.count() == 14 and best >= 11
    assert ranking.tournament(scores.limit(2).select("id"), None).select("bt").distinct().first()[0] == 0.0


def test_stop_rule():
    assert not ranking.should_stop([5.0], 100, 1)
    assert not ranking.should_stop([5.0, 0.1], 100, 4)
    assert ranking.should_stop([5.0, 3.0, 0.5, 0.5], 100, 4)
    assert ranking.should_stop([2.0, 2.0, 5.0, 5.0], 100, 4)


def test_section_order(spark):
    rows = [("A", 6.0)] * 2 + [("B", 4.0)] * 5 + [("Other", 9.0)] * 3
    df = spark.createDataFrame([(i, c, c, r) for i, (c, r) in enumerate(rows)], "id long, cat string, section_title string, rating double")
    got = {r["cat"]: (round(r["score"], 3), r["sort_order"]) for r in edits.section_order(df).collect()}
    assert got == {"B": (7.167, 0), "A": (6.592, 1), "Other": (0, 2)}


STORY = "id long, cat string, section_title string, headline string, prune boolean"
EDIT = "ord int, id long, action string, rewritten_headline string, target_category string"


def test_edits(spark):
    stories = spark.createDataFrame([(i, "A", "TA", f"h{i}", True) for i in range(1, 5)], STORY)
    titles = spark.createDataFrame([("A", "TA"), ("B", "TB")], "cat string, section_title string")
    todo = spark.createDataFrame(
        [(1, 1, "rewrite", "X", None), (2, 1, "move", None, "B"), (3, 2, "move", None, "Z"), (4, 3, "drop", None, None), (5, 4, "keep", None, None)], EDIT)
    got = {r["id"]: (r["cat"], r["section_title"], r["headline"], r["prune"]) for r in edits.apply_edits(stories, todo, titles).collect()}
    assert got == {1: ("B", "TB", "X", False), 2: ("A", "TA", "h2", False), 3: ("Other", "Other News", "h3", True), 4: ("A", "TA", "h4", False)}
    same = edits.apply_edits(stories, todo.limit(0), titles)
    assert {r["id"]: r["headline"] for r in same.collect()} == {i: f"h{i}" for i in range(1, 5)}


def test_single_sections(spark):
    df = spark.createDataFrame([(1, "A", "t"), (2, "B", "t"), (3, "B", "t")], "id long, cat string, section_title string")
    got = {r["id"]: (r["cat"], r["section_title"]) for r in edits.singles_to_other(df).collect()}
    assert got == {1: ("Other", "Other News"), 2: ("B", "t"), 3: ("B", "t")}


def test_dupe_boost(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, rating double")
    marks = spark.createDataFrame([(0, -1), (1, -1), (2, 1), (3, 1), (4, 0)], "id long, dupe_id long")
    assert {r["id"]: r["rating"] for r in neardup.boost_and_drop(df, marks).collect()} == {0: 2.0, 1: 3.0}


@pytest.mark.parametrize("received,verdict", [([1, 3, 4], "id mismatch"), ([2, 1, 3], "order mismatch"), ([1, 2], "count mismatch"), ([1, 2, 3], "ok")])
def test_response_check(spark, received, verdict):
    schema = "chunk int, pos int, id long"
    sent = spark.createDataFrame([(0, i, x) for i, x in enumerate([1, 2, 3])], schema)
    back = spark.createDataFrame([(0, i, x) for i, x in enumerate(received)], schema)
    assert model.response_report(sent, back).first()["verdict"] == verdict
    if verdict == "ok":
        model.check_response([1, 2, 3], received)
    else:
        with pytest.raises(model.ResponseError):
            model.check_response([1, 2, 3], received)


def test_model_column_chunks_and_retries(spark):
    df = spark.range(60).select("id", F.lit("x").alias("text")).coalesce(1)
    out = model.model_column(df, lambda c: [{"id": r["id"], "n": len(c)} for r in c], ["text"], "n", "int")
    assert sorted(r["n"] for r in out.collect()) == [10] * 10 + [25] * 50
    wrong = model.model_column(df, lambda c: c[:-1], ["text"], "n", "int", attempts=1, default=7, on_error="default")
    assert {r["n"] for r in wrong.collect()} == {7}


def test_accuracy(spark):
    truth = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True)], "input string, output boolean")
    pred = spark.createDataFrame([("m", "a", True), ("m", "b", False), ("m", "c", True), ("m", "d", True)], "model string, input string, output boolean")
    both = evaluate.compare(pred, truth)
    assert evaluate.accuracy(both).first()["accuracy"] == 0.75
    assert evaluate.wrong(both).count() == 1


def test_catalog(spark):
    schema = ("name string, type string, url string, rss string, include array<string>, exclude array<string>, scroll double, "
              "initial_sleep double, minlength double, function_name string")
    rows = [("a", "ftp", None, None, None, None, None, None, None, None), ("b", "html", None, None, None, None, None, None, None, None),
            ("c", "rss", "u", None, ["["], None, None, None, None, None), ("d", "rss", "u", None, None, None, -1.0, None, None, None),
            ("e", "rss", "u", None, ["x"], None, 1.0, None, None, None)]
    got = sorted((r["name"], r["level"]) for r in catalog.check_catalog(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "ERROR"), ("b", "ERROR"), ("c", "ERROR"), ("d", "WARNING")]


def test_composite_score(spark):
    assert spark.range(1).select(clustering.composite_score(F.lit(0.4), F.lit(-0.2))).first()[0] == 0.2


def test_crawl_plan(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "ord long, host string")
    got = {r["ord"]: r["earliest_s"] for r in edits.crawl_plan(df, "host", ["ord"], 2.0).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 0.0, 3: 4.0}


def test_feed_cut_and_reorder(spark):
    posts = spark.sql("select stack(4, 0, 'p1', 1, 'p2', 2, 'p3', 3, 'p4') as (ord, text)").withColumn("ts", F.to_timestamp(F.lit("2025-01-01")))
    now = F.to_timestamp(F.lit("2025-01-01 01:00:00"))
    assert ids(tables.newest_until(posts, "p3", now), "text") == ["p1", "p2"]
    assert tables.newest_until(posts, "absent", now).count() == 4
    wanted = spark.createDataFrame([([2, 0],)], "l array<int>")
    assert [r["text"] for r in tables.reorder(posts, "ord", wanted, "l").collect()] == ["p3", "p1"]


def test_category_proposal(spark):
    df = spark.createDataFrame([(["X"], 6.0)] * 2 + [(["Y"], 4.0)] * 5, "topics array<string>, rating double")
    got = [(r["topic"], round(r["priority"], 3)) for r in model.propose_categories(df, "topics", "rating").collect()]
    assert got == [("Y", 7.167), ("X", 6.592)]


def test_rows_statistics(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, v double")
    out = stats.add_minmax(stats.add_zscore(df, "v", "z"), "v", "m").collect()
    assert {(r["z"], r["m"]) for r in out} == {(0.0, 0.5)}


def page(spark, head="", body="", url="https://p.example/a/"):
    doc = f"<html><head>{head}</head><body>{body}</body></html>"
    return spark.createDataFrame([(1, "src", url, doc)], "page_id long, source string, url string, html string")


def test_page_description_and_times(spark):
    now = F.to_timestamp(F.lit("2025-03-10"))
    tw = html.page_facts(page(spark, "<meta name='twitter:description' content=' tw '>"))
    assert tw.select(html.description()).first()[0] == "tw"
    assert html.page_facts(page(spark)).select(html.description()).first()[0] == ""
    meta = '<meta property="article:published_time" content="2025-01-01">'
    ld = '<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2025-02-02"}</script>'
    assert html.page_facts(page(spark, meta)).select(html.last_updated(now)).first()[0] == "2025-01-01T00:00:00Z"
    assert html.page_facts(page(spark, meta + ld)).select(html.last_updated(now)).first()[0] == "2025-02-02T00:00:00Z"
    header = html.page_facts(page(spark)).select(html.last_updated(now, F.lit("Thu, 02 Jan 2025 03:04:05 GMT")))
    assert header.first()[0] == "2025-01-02T03:04:05Z"


def test_page_tags(spark):
    head = '<meta name="keywords" content="a, b"><script type="application/ld+json">{"keywords": ["b", "c"]}</script>'
    assert html.page_facts(page(spark, head)).select(html.tags()).first()[0] == ["a", "b", "c"]


def test_page_links(spark):
    long = "A headline that is long enough, yes"
    body = (
        f"<a href='/x?q=1'> {long} </a><a href='b'>{'t' * 28}</a><a href='c'>{'t' * 29}</a><a href='/d'>123</a><a href='/e'>LINK</a>"
        f"<a href='mailto:me@x'>{long}</a><a href='https://q.example/'>{long}</a><a>{long}</a><script>var s = '<a href=\"/z\">{long}</a>'</script>"
        f"<a href='/f'><b>Bold</b> part &amp; {long}</a>"
    )
    got = {r["url"]: r["title"] for r in html.page_links(page(spark, body=body)).collect()}
    assert got == {
        "https://p.example/x": long, "https://p.example/a/c": "t" * 29, "https://p.example/e": "LINK", "https://p.example/a/": long,
        "https://p.example/f": f"Boldpart & {long}",
    }
    based = html.page_links(page(spark, "<base href='https://other.example/r/'>", "<a href='c'>" + long + "</a>"))
    assert based.first()["url"] == "https://other.example/r/c"
    og = spark.createDataFrame([("https://p.example/e", "Real title")], "url string, og_title string")
    named = html.page_links(page(spark, body="<a href='/e'>LINK</a>"), min_length=3, titles=og)
    assert named.first()["title"] == "Real title"


def test_page_text(spark):
    head = '<title>T &amp; U</title><meta property="og:title" content="Card"><meta name="twitter:description" content="About">'
    body = "<nav>menu</nav><article><h1>Head</h1><p>One  <b>two</b><br>three <|end|></p></article><footer>foot</footer>"
    got = html.page_facts(page(spark, head, body)).select(html.page_text("html")).first()[0]
    assert got == "Page title: T & U\nSocial card title: Card\nSocial card description: About\nHead\nOne two\nthree <|end|>".replace(" <|end|>", "")


def test_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.concatenate([c + rng.normal(scale=0.4, size=(25, 2)) for c in centres] + [np.array([[5.0, 5.0], [30.0, 30.0]])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.density_clusters(df, "id", "vec", 8, 4).collect()}
    for part in range(3):
        labels = [got[i] for i in range(part * 25, part * 25 + 25)]
        common = max(set(labels), key=labels.count)
        assert common >= 0 and labels.count(common) >= 20
    assert len({got[i] for i in range(75)} - {-1}) == 3
    assert got[76] == -1


def test_components(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = spark.range(39).filter("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["comp"] for r in clustering.connected_components(nodes, edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}


def test_reduced_dimensions_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6)) * np.array([5, 3, 2, 1, 1, 1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: np.array(r["vec"]) for r in clustering.reduce_dimensions(df, "id", "vec", 2).collect()}
    basis = np.linalg.svd(x, full_matrices=False)[2][:2].T
    want = x @ basis
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    for i in range(50):
        assert np.allclose(np.abs(got[i]), np.abs(want[i]), atol=1e-6)


def test_greedy_order(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [5.0]), (3, 0, [1.0]), (4, 0, [3.0])], "id long, c int, v array<double>")
    got = {r["id"]: r["sort_order"] for r in clustering.neighbour_order(df, "id", "c", "v").collect()}
    assert got == {1: 0, 3: 1, 4: 2, 2: 3}


def test_registered_domain_of_any_suffix(spark):
    from newsflow.functions import urls

    rows = [("https://foo.xyz/a", "foo.xyz"), ("news.cloud", "news.cloud"), ("http://192.168.1.1:80/x", "192.168.1.1"), ("https://www.a.gov.br", "a.gov.br"),
            ("https://x.a.co.uk/", "a.co.uk"), ("co.uk", ""), ("localhost", "localhost"), ("", ""), (None, "")]
    frame = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "i int, u string")
    suffixes = spark.createDataFrame([("com",), ("co.uk",)], "suffix string")
    for out in (frame.withColumn("domain", urls.registered_domain("u")), urls.with_registered_domain(frame, "u", suffixes)):
        assert [r["domain"] for r in out.orderBy("i").collect()] == [want for _, want in rows]


def test_repeated_ids_in_responses(spark):
    from newsflow.operators import dedup, model

    sent = spark.createDataFrame([("c", 1, 1), ("c", 2, 2)], "chunk string, pos int, id int")
    received = spark.createDataFrame([("c", 1, 1), ("c", 2, 1)], "chunk string, pos int, id int")
    report = model.response_report(sent, received).first()
    assert (report["n_sent"], report["n_received"], report["n_missing"], report["n_extra"], report["verdict"]) == (2, 2, 1, 1, "id mismatch")
    found = dedup.id_set_differences(sent, received, ["chunk", "id"], "pos").collect()
    assert sorted((r["id"], r["status"]) for r in found) == [(1, "extra"), (1, "ok"), (2, "missing")]


def test_marks_and_losers_with_copies(spark):
    from newsflow.operators import neardup

    rows = spark.createDataFrame([(1, [1.0, 0.0], "A", 1), (2, [1.0, 0.0], "B", 9), (3, [1.0, 0.0], "B", 9), (4, [0.0, 1.0], "B", 5)], "id long, v array<double>, cat string, len int")
    marks = {r["id"]: r["dupe_id"] for r in neardup.similar_marks(rows, "id", "v", "cat", 0.9).collect()}
    assert marks == {1: -1, 2: -1, 3: 2, 4: -1}
    near = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.05], 5), (3, [1.0, 0.0], 9)], "id long, v array<double>, len int")
    assert sorted(r["id"] for r in neardup.similar_losers(near, "id", "v", "len", 0.9).collect()) == [1, 2]


def test_links_with_quoted_angle_brackets(spark):
    from newsflow.sources import html

    page = """<html><body><a title='a > b' href='/p/1'>One</a> <a href="/p/2" data-x="it's">Two</a> <a href=/p/3 title="open>Three</a></body></html>"""
    frame = spark.createDataFrame([(1, "s", "https://x.example/", page)], "page_id long, source string, url string, html string")
    assert [(r["href"], r["title"]) for r in html.raw_links(frame).orderBy("ord").collect()] == [("/p/1", "One"), ("/p/2", "Two"), ("/p/3", "Three")]


def test_stream_keeps_late_items(spark, tmp_path):
    from newsflow.streaming.seen import stream_unseen

    old = spark.sql("select 'https://a/0' initial_url, '' final_url, 't' title, 's' source, false isAI, timestamp'2024-01-01' created_at")
    old.write.parquet(f"{tmp_path}/history/version=0")
    schema = "id long, url string, source string, title string, isAI boolean, published timestamp"
    days = ["2024-01-10", "2024-01-11", "2024-01-01"]
    got = []
    for run, day in enumerate(days):
        rows = [(run * 3 + k, f"https://a/{run + k}", "s", f"t{run * 3 + k}", True, None) for k in range(2)]
        spark.createDataFrame(rows, schema).withColumn("published", F.to_timestamp(F.lit(day))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream_unseen(stream, f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got.append(sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [["https://a/1"], ["https://a/1", "https://a/2"], ["https://a/1", "https://a/2", "https://a/3"]]
    history = spark.read.parquet(f"{tmp_path}/history")
    assert history.count() == history.select("initial_url").distinct().count() == 4


def test_near_texts_by_exact_terms(spark):
    """Against brute force: other words never count as the same, copies and missing lengths do as with vectors."""
    import math
    import random

    draw = random.Random(3)
    texts = []
    for i in range(120):
        base = [f"w{draw.randrange(3000)}" for _ in range(30)] + ["common"] * 3
        texts += [" ".join(base), " ".join(base[1:]) if i % 3 else " ".join(reversed(base))]
    texts += ["", None, "...", "common"]
    rows = [(i, t, None if i % 11 == 0 else 100 + i % 5) for i, t in enumerate(texts)]
    words = {i: {w: t.lower().split().count(w) for w in t.lower().split()} for i, t, _ in rows if t and t != "..."}
    total = sum(bool(t) for t in texts)
    share = {w: sum(w in v for v in words.values()) for v in words.values() for w in v}
    unit = {}
    for i, v in words.items():
        x = {w: c * math.log((1 + total) / (1 + share[w])) for w, c in v.items()}
        unit[i] = {w: y / math.sqrt(sum(z * z for z in x.values())) for w, y in x.items()}
    size = {i: n for i, _, n in rows}
    lost = set()
    for a in unit:
        for b in unit:
            if a < b and sum(x * unit[b].get(w, 0) for w, x in unit[a].items()) > 0.925:
                longer = size[a] is not None and size[b] is not None and size[a] > size[b]
                lost.add(b if longer else a)
    df = spark.createDataFrame(rows, "id long, text string, content_length int")
    assert set(ids(neardup.drop_near_texts(df, threshold=0.925))) == set(range(len(rows))) - lost and len(lost) > 100
    assert neardup.drop_near_texts(df.limit(0), threshold=0.925).count() == 0


def test_centroids_of_several_blocks(spark, monkeypatch):
    """Chunks of rows and centroids give what all at once give, ties go to the first name, and centroids stay off the driver."""
    import numpy as np

    draw = np.random.default_rng(5)
    x, c = draw.normal(size=(40, 6)), draw.normal(size=(30, 6))
    c[11] = c[10] * 2
    x[0], x[1] = c[10], 0
    names = [f"c{i:02d}" for i in range(30)]
    sims = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    want = {i: names[int(np.argmax(np.round(s, 12)))] if s.max() >= 0.6 else "Other" for i, s in enumerate(sims)} | {40: "Other", 41: "Other"}
    rows = spark.createDataFrame([(i,) for i in range(42)], "id long")
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(41, None)], "id long, embedding array<double>")
    centres = spark.createDataFrame(list(zip(names, c.tolist())), "cat string, centroid array<double>")
    monkeypatch.setattr(model, "CHUNK", 7)
    with monkeypatch.context() as m:
        m.setattr(type(centres), "collect", None)
        found = model.assign_by_centroid(rows, emb, centres, "id", "cat")
    assert {r["id"]: r["cat"] for r in found.collect()} == want
    assert {r["cat"] for r in model.assign_by_centroid(rows, emb, centres.limit(0), "id", "cat").collect()} == {"Other"}


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
def test_summary_by_exact_terms(spark, share, monkeypatch):
    """Equal to a plain computation, however many terms count as frequent."""
    monkeypatch.setattr(model, "FREQUENT", share)
    draw = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(30)] + ["Été", "the", "THE"]
    texts = {i: " ".join(pool[int(j)] + draw.choice(["", "", "", ".", "!\n"]) for j in draw.integers(0, len(pool), draw.integers(1, 60))) for i in range(40)}
    texts |= {40: None, 41: "", 42: "... !!", 43: "same words. same words. same words. same words.", 44: "the " * 5000}
    words = {i: [re.findall(r"\w+", p.lower()) for p in re.split(r"\n+", re.sub(r"([.!?])\s+", r"\1\n", t or ""))] for i, t in texts.items()}
    seen = {}
    for i, pieces in words.items():
        for w in {w for p in pieces for w in p}:
            seen[w] = seen.get(w, 0) + 1
    want = []
    for i, pieces in words.items():
        scores = [(round(sum(math.log((1 + len(texts)) / (1 + seen[w])) for w in p), 6), pos) for pos, p in enumerate(pieces) if p]
        want += [(i, rank + 1, pos, score) for rank, (score, pos) in enumerate(sorted(scores, key=lambda s: (-s[0], s[1]))[:3])]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "id long, text string, weight double")
    got = sorted((r["id"], r["rank"], r["pos"], r["score"]) for r in model.extract_summary(frame, "id", "text").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert model.extract_summary(frame.limit(0), "id", "text").count() == 0


def test_fetch_records(spark):
    rows = [(1, 200, "é"), (2, 404, "x"), (3, 200, None), (4, 200, ""), (5, None, "x")]
    frame = spark.createDataFrame(rows, "id long, code int, body string")
    got = [tuple(r) for r in evaluate.fetch_records(frame, F.col("code") == 200, "body", ["id"]).orderBy("id").collect()]
    assert got == [(1, "success", 2), (2, "failed", 0), (3, "failed", 0), (4, "success", 0), (5, "failed", 0)]


def test_model_with_declared_output(spark):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    output = T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.LongType())])
    answer = lambda chunk: [{"id": r["id"], "size": len(r["text"]) + r["id"]} for r in chunk]
    assert sorted(map(tuple, model.model_table(frame, answer, ["text"], output).collect())) == [(i, 2 + i) for i in range(5)]
    with pytest.raises(ValueError):
        model.model_table(frame, answer, ["text"], T.StructType([*output.fields, T.StructField("more", T.LongType())]))
