"""Files written and read back."""

import os

from pyspark.sql import functions as F

from newsflow.sources import sinks, tables


def test_truth_file_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text('input,output\nplain,True\n"with, comma",False\n"two\nlines and ""quotes""",True\n', encoding="utf-8")
    got = {r["input"]: r["output"] for r in tables.read_truth(spark, str(path)).collect()}
    assert got == {"plain": True, "with, comma": False, 'two\nlines and "quotes"': True}


def test_texts_by_path(spark, tmp_path):
    for name, body in (("a.txt", "one\ntwo"), ("b.txt", "")):
        (tmp_path / name).write_text(body, encoding="utf-8")
    files = tables.read_text_files(spark, str(tmp_path))
    prefix = files.filter("path like '%a.txt'").first()["path"].rsplit("/", 1)[0]
    df = spark.createDataFrame(
        [(1, f"{prefix}/a.txt"), (2, f"{prefix}/b.txt"), (3, f"{prefix}/gone.txt"), (4, None), (5, "download/text/.txt")], "id long, text_path string")
    assert [(r["id"], r["text"]) for r in tables.texts_by_path(df, files).collect()] == [(1, "one\ntwo")]


def test_snapshots_per_session_and_step(spark, tmp_path):
    root = str(tmp_path / "steps")
    df = spark.range(3)
    sinks.write_snapshot(df, root, "s1", "gather")
    sinks.write_snapshot(df.limit(1), root, "s1", "rate")
    sinks.write_snapshot(df.limit(2), root, "s1", "gather")  # replaces its own snapshot only
    assert sinks.read_snapshot(spark, root, "s1", "gather").count() == 2
    assert sinks.read_snapshot(spark, root, "s1").count() == 3
    assert sinks.read_snapshot(spark, root, "other").count() == 0


def test_latest_trial(spark, tmp_path):
    path = str(tmp_path / "trials")
    for stamp, score in (("2025-01-02", 0.5), ("2025-01-01", 0.9)):
        sinks.append_trial(spark.sql(f"select timestamp'{stamp}' as timestamp, {score}D as score"), path)
    assert sinks.latest_trial(spark, path).first()["score"] == 0.5


def test_document(spark, tmp_path):
    rows = [(1, 0, "First", 2.0, "b"), (2, 0, "First", 3.0, "a"), (3, 1, "Second", 1.0, "c")]
    df = spark.createDataFrame(rows, "id long, sort_order long, title string, rating double, headline string")
    lines = sinks.document_lines(df, "sort_order", "title", [F.desc("rating"), "id"], F.concat(F.lit("- "), "headline"))
    out = str(tmp_path / "doc")
    sinks.write_document(lines, "sort_order", out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p), encoding="utf-8").read() for p in parts)
    assert text == "## First\n- a\n- b\n## Second\n- c\n"


def test_feed_and_api_items(spark):
    entries = spark.createDataFrame(
        [(i, "s", "t", "t" if i else "d", "u", None, "", "about") for i in range(60)],
        "ord long, source string, title string, title_detail string, url string, published string, summary string, description string")
    got = tables.feed_items(entries).orderBy("ord").collect()
    assert len(got) == 50 and got[0]["title"] == "t: d" and got[1]["title"] == "t" and got[0]["rss_summary"] == "about"
    bodies = spark.createDataFrame([(0, '{"articles": [{"title": "A", "url": "u", "publishedAt": "p"}, {}]}'), (1, "{}")], "ord long, body string")
    assert [(r["title"], r["published"]) for r in tables.api_items(bodies, "body", "x").orderBy("pos").collect()] == [("A", "p"), ("", "")]
