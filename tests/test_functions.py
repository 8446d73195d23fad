"""Hand-computed cases of the column functions."""

import math

from pyspark.sql import functions as F

from newsflow.functions import arrays, scores, text, urls


def one(spark, column, **values):
    """Value of a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def test_clean_url(spark):
    assert one(spark, urls.clean_url("u"), u="http://x.example/a?utm=1#f") == "http://x.example/a"
    assert one(spark, urls.clean_url("u"), u="https://m.y.example/en/25#top") == "https://m.y.example/en/25#top"


def test_url_parts(spark):
    u = "HTTPS://me:pw@News.Example.com:8080/a/b?c#d"
    assert one(spark, urls.host("u"), u=u) == "news.example.com"
    assert one(spark, urls.authority("u"), u=u) == "me:pw@News.Example.com:8080"
    assert one(spark, urls.path("u"), u=u) == "/a/b"
    assert one(spark, urls.has_path("u"), u="https://a.example/?q=1") is False


def test_registered_domain(spark):
    cases = {"https://www.bbc.co.uk/x": "bbc.co.uk", "http://a.b.archive.is": "archive.is", "localhost": "localhost", "": "", "co.uk": ""}
    for url, domain in cases.items():
        assert one(spark, urls.registered_domain("u"), u=url) == domain
    assert one(spark, urls.registered_domain(F.lit(None).cast("string")), u="x") == ""


def test_safe_filename(spark):
    assert one(spark, urls.safe_filename("t"), t='AI: "what/next"? Été (2025)') == "AI___what_next___Été__2025"


def test_patterns_must_all_match(spark):
    include = ["^https://a/", ".*x"]
    kept = [u for u in ("https://a/x", "https://a/y", "http://b/x") if one(spark, urls.matches_all("u", include), u=u)]
    assert kept == ["https://a/x"]
    assert one(spark, urls.matches_any("u", ["b", "https"]), u="https://a") is True
    assert one(spark, urls.matches_any("u", ["a"]), u="ba") is False
    arr = F.array(F.lit("https"), F.lit(".*x"))
    assert one(spark, urls.matches_all("u", arr), u="https://a/x") is True


def test_absolute_url(spark):
    assert one(spark, urls.absolute_url("b", "h"), b="https://a.example/x/y", h="../z") == "https://a.example/z"
    assert one(spark, urls.absolute_url("b", "h"), b="https://a.example/x/y", h="mailto:q") == "mailto:q"


def test_topics(spark):
    assert one(spark, arrays.topics_to_text("t"), t=F.array(F.lit(" AI/ML "), F.lit(""), F.lit("NLP"))) == "AI/ML,NLP"
    assert one(spark, arrays.topics_to_text("t"), t=F.array().cast("array<string>")) is None
    assert one(spark, arrays.text_to_topics("t"), t="a, ,b") == ["a", "b"]
    assert one(spark, arrays.text_to_topics("t"), t=F.lit(None).cast("string")) == []


def test_vocabulary_keeps_order_and_repeats(spark):
    got = one(spark, arrays.keep_vocabulary("t", ["b", "a"]), t=F.array(*[F.lit(x) for x in "axba"]))
    assert got == ["a", "b", "a"]
    assert one(spark, arrays.keep_vocabulary("t", ["b"]), t=F.lit(None).cast("array<string>")) == []


def test_scores(spark):
    for age, want in ((0, 1), (1, 0), (2, -0.5), (3, -0.75)):
        assert math.isclose(one(spark, scores.recency_score("a"), a=float(age)), want, abs_tol=1e-12)
    for n, want in ((0, 0), (500, 0), (1000, 0), (5000, math.log10(5)), (10000, 1), (100000, 2), (1000000, 2)):
        assert math.isclose(one(spark, scores.length_score("n"), n=n), want, abs_tol=1e-12)
    for z, want in ((-1.5, 0), (0.0, 2.25), (2.0, 5.25)):
        assert one(spark, scores.tournament_points("z"), z=z) == want


def test_token_probability(spark):
    tops = F.array(
        F.struct(F.lit("1").alias("token"), F.lit(math.log(0.8)).alias("logprob")),
        F.struct(F.lit("0").alias("token"), F.lit(math.log(0.2)).alias("logprob")))
    assert math.isclose(one(spark, arrays.token_probability("t", "1"), t=tops), 0.8)
    assert one(spark, arrays.token_probability("t", "x"), t=tops) == 0


def test_redaction(spark):
    cases = {
        "api_key=abcdefgh123 ok": "[API_KEY_REDACTED] ok",
        "Authorization: Bearer xyz.abc": "[API_KEY_REDACTED] xyz.abc",
        "https://a.example/x?token=12345678&y=1": "https://a.example/x?[API_KEY_REDACTED]&y=1",
        "plain text": "plain text",
    }
    for raw, clean in cases.items():
        assert one(spark, text.redact_secrets("t"), t=raw) == clean


def test_markdown_links(spark):
    got = one(spark, text.markdown_links("t"), t="[A](u1) [B](u2)")
    assert [(x["name"], x["url"]) for x in got] == [("A", "u1"), ("B", "u2")]


def test_text_helpers(spark):
    assert one(spark, text.first_line("t"), t="\n \n **Title** \nrest") == "Title"
    assert one(spark, text.drop_cut_word("t"), t="one two thr...") == "one two"
    assert one(spark, text.truncate_tokens("t", 2), t="a  b c") == "a b"
    assert one(spark, text.truncate_tokens("t", 3), t="a  b c") == "a  b c"
    assert one(spark, text.word_count("t"), t="  ") == 0


def test_time_parsing(spark):
    now = F.to_timestamp(F.lit("2025-03-10 00:00:00"))
    cases = {
        "2025-01-02T03:04:05Z": "2025-01-02T03:04:05Z", "2025-01-02T03:04:05.123+02:00": "2025-01-02T01:04:05Z",
        "2025-01-02": "2025-01-02T00:00:00Z", "Thu, 02 Jan 2025 03:04:05 +0100": "2025-01-02T02:04:05Z",
        "Thu, 02 Jan 2025 03:04:05 GMT": "2025-01-02T03:04:05Z", "rubbish": "2025-03-09T00:00:00Z",
    }
    for raw, want in cases.items():
        assert one(spark, scores.zulu(scores.parse_time("t", now)), t=raw) == want, raw
    assert one(spark, scores.duration_text("a", "b"), a="2025-01-01 00:00:00", b="2025-01-01 00:02:05") == "2:05"


def test_json_ld(spark):
    scripts = F.array(
        F.lit('{"keywords": ["a", "b"], "articleSection": "s"}'), F.lit('[{"keywords": "c, d"}, {"articleSection": ["t"]}]'), F.lit("{bad"))
    assert one(spark, F.array_sort(arrays.json_ld_tags("s")), s=scripts) == ["a", "b", "c", "d", "s", "t"]
