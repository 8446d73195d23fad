"""Stages of a news run as functions from tables to tables.

Each stage selects what it needs and returns one stored table, as operators read their input
several times. Callers keep a copy per session with ``sinks.write_snapshot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import scores, text, urls
from newsflow.operators import clustering, dedup, edits, history, mmr, model, neardup
from newsflow.session import cut_lineage
from newsflow.sources import html


def filter_items(items: DataFrame, seen: DataFrame, relevance: DataFrame, since: Column | None = None) -> DataFrame:
    """Items with a new URL, once each, that a model (``id``, ``isAI``) calls relevant."""
    unique = dedup.first_per_key(items.withColumn("url", urls.clean_url("url")), ["url"], ["id"])
    new = history.unseen_items(unique, seen, since)
    judged = new.join(relevance.select("id", "isAI"), "id", "left")
    return cut_lineage(judged.filter(F.coalesce("isAI", F.lit(False))))


def read_pages(items: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Items with the text, description, tags and time of their downloaded page."""
    facts = html.page_facts(pages)
    content = html.page_text("html")
    parts = facts.select(
        "url", html.final_url("url").alias("final_url"), html.description().alias("description"), html.tags().alias("tags"),
        html.last_updated(now).alias("last_updated"), content.alias("text"),
    ).withColumn("content_length", F.coalesce(F.length("text"), F.lit(0)))
    joined = items.join(parts, "url", "left")
    return cut_lineage(joined.withColumn("content_length", F.coalesce("content_length", F.lit(0))))


def unique_articles(
    articles: DataFrame, seen: DataFrame, sites: DataFrame, embeddings: DataFrame, threshold: float = 0.925,
    since: Column | None = None,
) -> DataFrame:
    """Longest copy per final URL, new after redirects, without near duplicates, with site data."""
    best = dedup.first_per_key(articles, ["final_url"], [F.desc("content_length"), "id"])
    new = cut_lineage(history.unseen_after_redirect(best, seen, since))
    kept = neardup.drop_near_duplicates(new, embeddings, threshold=threshold)
    address = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))
    return cut_lineage(model.add_sites(kept.withColumn("domain", urls.registered_domain(address)), sites))


def rate_articles(articles: DataFrame, verdicts: DataFrame, strengths: DataFrame, now: Column) -> DataFrame:
    """Articles of the last week with ``rating``; ``verdicts`` and ``strengths`` join by id."""
    stamp = scores.parse_time(scores.plausible_time("last_updated", now), now)
    aged = articles.withColumn("age", scores.age_days(F.coalesce(stamp, now - F.expr("interval 1 day")), now)).filter("age < 7")
    joined = aged.join(verdicts.select("id", "on_topic", "important", "low_quality"), "id", "left").join(
        strengths.select("id", "bt_z"), "id", "left")
    rating = scores.composite_rating(
        "reputation", scores.length_score("content_length"), "on_topic", "important", "low_quality", F.lit(0.0),
        scores.recency_score("age"))
    return cut_lineage(joined.withColumn("rating", rating + F.coalesce(scores.tournament_points("bt_z"), F.lit(0.0))))


def cluster_articles(articles: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """Articles with the number and name of their cluster."""
    vecs = embeddings.select("id", "embedding")
    labels = clustering.density_clusters(vecs, "id", "embedding", **options)
    labelled = articles.join(labels, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    names = clustering.name_clusters(labelled, "cluster", "topics").select("cluster", F.col("name").alias("cluster_label"))
    return cut_lineage(labelled.join(names, "cluster", "left"))


def select_stories(articles: DataFrame, embeddings: DataFrame, total: int = 100) -> DataFrame:
    """The stories of an issue in section order: must-haves, a diverse rest, small sections merged."""
    chosen = cut_lineage(mmr.tiered_select(articles, embeddings, total))
    named = chosen.withColumn("cat", text.or_other("cat")).withColumn("section_title", F.col("cat"))
    merged = edits.singles_to_other(named)
    return cut_lineage(edits.add_section_order(merged, edits.section_order(merged)))
