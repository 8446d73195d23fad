"""Registered queries against their SQL on the smallest tables, and plans that must hold."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from newsflow.plans import load_queries, stages

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = load_queries()

# Those of the training-data package have tests of their own.
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, cursor.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, small):
    shown = plan(QUERIES["value_counts"](spark, small))
    assert "ReadSchema: struct<lang:string>" in shown
    shown = plan(QUERIES["log_search"](spark, small))
    pushed = shown[shown.index("PushedFilters"):]
    assert "EqualTo(event_type,error)" in pushed and "EqualTo(user_id,8)" in pushed


@pytest.mark.parametrize("name", ["redact_secrets", "recency_rating", "url_clean_host", "topic_vocab", "summary_texts"])
def test_expressions_stay_in_the_jvm(spark, small, name):
    shown = plan(QUERIES[name](spark, small))
    assert "Python" not in shown and "Arrow" not in shown


@pytest.mark.parametrize("name", ["dedup_exact_best", "cap_per_source", "upsert_latest"])
def test_ranks_are_limited_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, small))


def test_stages_run_in_order(spark):
    now = F.to_timestamp(F.lit("2025-01-05"))
    long = "word " * 60
    items = spark.createDataFrame(
        [(1, "https://a.example.com/1?x", "s", "t1"), (2, "https://a.example.com/1", "s", "t2"), (3, "https://b.example.com/3", "s", "t3"),
         (4, "https://c.example.com/4", "s", "t4"), (5, "https://d.example.com/5", "s", "t5")],
        "id long, url string, source string, title string")
    seen = spark.sql("select 'https://c.example.com/4' initial_url, '' final_url, 'z' title, 'q' source, timestamp'2025-01-01' created_at")
    relevance = spark.createDataFrame([(1, True), (3, True), (4, True), (5, False)], "id long, isAI boolean")
    fresh = stages.filter_items(items, seen, relevance)
    assert sorted(r["id"] for r in fresh.collect()) == [1, 3]
    pages = spark.createDataFrame(
        [("https://a.example.com/1", f"<html><head><title>A</title></head><body><p>{long}</p></body></html>"),
         ("https://b.example.com/3", "<html><head><meta name='pubdate' content='2025-01-04'></head><body><p>short</p></body></html>")],
        "url string, html string")
    read = stages.read_pages(fresh, pages, now)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    sites = spark.createDataFrame([("example.com", "Example", 2.0)], "domain_name string, site_name string, reputation double")
    unique = stages.unique_articles(read, seen, sites, vectors)
    verdicts = spark.createDataFrame([(1, 1.0, 0.5, 0.0)], "id long, on_topic double, important double, low_quality double")
    strengths = spark.createDataFrame([(1, 0.0), (3, 0.0)], "id long, bt_z double")
    rated = stages.rate_articles(unique, verdicts, strengths, now)
    got = {r["id"]: r["rating"] for r in rated.collect()}
    assert got[3] == pytest.approx(2 + 0 + 1 + 1 + 0 + 2.25)
    chosen = stages.select_stories(rated.withColumn("cat", F.lit(None).cast("string")), vectors)
    assert {r["cat"] for r in chosen.collect()} == {"Other"}


def test_stream_equals_batch(spark, small):
    want = spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") % 700).alias("k"), (F.col("doc_id") % 9 == 0).alias("seen"))
    seen = {r["k"] for r in want.filter("seen").collect()}
    new = {f"https://n.example/{r['k']}" for r in want.collect() if r["k"] not in seen}
    got = [r["url"] for r in QUERIES["stream_unseen"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == new
