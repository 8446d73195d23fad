"""Sections and row edits: flattening, critique actions, repair of small groups, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.text import links_to_markdown, or_other
from newsflow.operators.dedup import first_per_key
from newsflow.operators.numbering import number_rows, number_within

OTHER, OTHER_TITLE = "Other", "Other News"


def flatten_sections(sections: DataFrame, ord: str = "ord") -> DataFrame:
    """One row per story of nested sections; a story that occurs twice counts once."""
    rows = sections.select("cat", "section_title", ord, F.posexplode("headlines").alias("_pos", "h"))
    stories = rows.select(
        "cat", "section_title", F.col("h.id").alias("id"), F.col("h.headline").alias("headline"),
        F.col("h.rating").alias("rating"), F.col("h.prune").alias("prune"),
        links_to_markdown(F.col("h.links")).alias("links"), ord, "_pos",
    )
    return first_per_key(stories, ["id"], [ord, "_pos"]).drop(ord, "_pos")


def apply_edits(stories: DataFrame, edits: DataFrame, titles: DataFrame) -> DataFrame:
    """Drop, rewrite and move actions in the order of ``ord``.

    ``titles`` maps a category to its section title (one row each); moves to other
    categories are ignored. ``drop`` sets ``prune`` for good and sends the story to Other;
    a later move may still change the category. Any other action does nothing.
    """
    wanted = edits.filter(F.col("id").isNotNull()).select("id", "ord", "action", "rewritten_headline", "target_category")
    checked = wanted.join(
        titles.select(F.col("cat").alias("target_category"), F.col("section_title").alias("_title")),
        "target_category", "left",
    )
    is_drop = F.col("action") == "drop"
    is_move = (F.col("action") == "move") & F.col("_title").isNotNull()
    is_rewrite = (F.col("action") == "rewrite") & (F.coalesce(F.col("rewritten_headline"), F.lit("")) != "")
    place = F.when(is_drop, F.struct(F.lit(OTHER).alias("c"), F.lit(OTHER_TITLE).alias("t"))).when(
        is_move, F.struct(F.col("target_category").alias("c"), F.col("_title").alias("t"))
    )
    # One aggregate per story: of each column the last effective value.
    net = checked.groupBy("id").agg(
        F.max(is_drop).alias("_drop"),
        F.max_by("rewritten_headline", F.when(is_rewrite, F.col("ord"))).alias("_headline"),
        F.max_by(place, F.when(is_drop | is_move, F.col("ord"))).alias("_place"),
        F.max(is_rewrite).alias("_rewritten"), F.max(is_drop | is_move).alias("_placed"),
    )
    out = stories.drop("prune").join(net, "id", "left")
    return out.select(
        *[
            F.when(F.col("_placed"), F.col("_place.c")).otherwise(F.col(c)).alias(c) if c == "cat"
            else F.when(F.col("_placed"), F.col("_place.t")).otherwise(F.col(c)).alias(c) if c == "section_title"
            else F.when(F.col("_rewritten"), F.col("_headline")).otherwise(F.col(c)).alias(c) if c == "headline"
            else F.col(c)
            for c in stories.columns if c != "prune"
        ],
        F.coalesce("_drop", F.lit(False)).alias("prune"),
    )


def drop_pruned(stories: DataFrame) -> DataFrame:
    return stories.filter(~F.col("prune"))


def singles_to_other(stories: DataFrame, key: str = "id") -> DataFrame:
    """Categories that have a section with a single story move to Other as a whole.

    Counting yields the few (category, title) groups of one; categories are looked up by
    Spark's own choice of join.
    """
    single = (
        stories.groupBy("cat", "section_title").agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 1").select("cat").distinct().withColumn("_single", F.lit(True))
    )
    out = stories.join(single, "cat", "left")
    moved = F.coalesce(F.col("_single"), F.lit(False))
    any_moved = F.coalesce(single.select(F.max("_single")).scalar(), F.lit(False))
    is_other = moved | ((F.col("cat") == OTHER) & any_moved)
    return out.select(*[
        F.when(moved, OTHER).otherwise(F.col(c)).alias(c) if c == "cat"
        else F.when(is_other, OTHER_TITLE).otherwise(F.col(c)).alias(c) if c == "section_title"
        else F.col(c) for c in stories.columns
    ])


def reassign_single_categories(
    df: DataFrame, assign: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", category: str = "cat"
) -> DataFrame:
    """Rows that are alone in their category get a category of several rows, or Other.

    ``assign(rows, candidates)`` returns ``(key, category)``; missing answers mean Other.
    A category of one is found with the id of its row, so the result joins on the id.
    """
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key))
    alone = counts.filter((F.col("n") == 1) & (F.col(category) != OTHER)).select(key)
    other = df.sparkSession.createDataFrame([(OTHER,)], f"{category} string")
    candidates = counts.filter("n > 1").select(category).unionByName(other).distinct()
    rows = df.join(alone, key, "left_semi")
    answers = assign(rows, candidates).select(key, or_other(category, OTHER).alias("_new"))
    fallback = alone.withColumn("_alone", F.lit(True))
    out = df.join(fallback, key, "left").join(answers, key, "left")
    new = F.when(F.col("_alone"), F.coalesce("_new", F.lit(OTHER))).otherwise(F.col(category))
    return out.withColumn(category, new).select(df.columns)


def weak_sections(critiques: DataFrame, least: float = 7.0) -> DataFrame:
    """Sections to draft again: asked for, and coherence or quality below the mark."""
    low = (F.col("coherence") < least) | (F.col("quality") < least)
    return critiques.filter(F.col("should_iterate") & low)


def section_stats(stories: DataFrame, key: str = "id", rating: str = "rating") -> DataFrame:
    """Mean rating and number of stories per (category, section title), groups with nulls left out."""
    named = stories.filter(F.col("cat").isNotNull() & F.col("section_title").isNotNull())
    return named.groupBy("cat", "section_title").agg(
        F.avg(rating).alias("rating"), F.count(key).alias("count")
    )


def section_order(stories: DataFrame, key: str = "id", rating: str = "rating") -> DataFrame:
    """``(cat, section_title, rating, count, score, sort_order)``, best section first, 0-based.

    The score is mean rating times ln(1 + stories); Other scores 0.
    """
    stats = section_stats(stories, key, rating)
    score = F.when(F.col("cat") == OTHER, 0.0).otherwise(F.col("rating") * F.log1p("count"))
    ranked = number_rows(stats.withColumn("score", score), [F.desc("score"), "cat", "section_title"], "_rn")
    return ranked.withColumn("sort_order", F.col("_rn") - 1).drop("_rn")


def add_section_order(stories: DataFrame, order: DataFrame) -> DataFrame:
    """Stories with the order of their category; of several titles the last one counts."""
    per_category = order.groupBy("cat").agg(F.max("sort_order").alias("sort_order"))
    return stories.join(per_category, "cat", "left")


def mark_section_starts(stories: DataFrame, order: list[Column | str]) -> DataFrame:
    """Position in the section and whether a new section header is due."""
    placed = number_within(stories, ["sort_order"], order, "pos")
    return placed.withColumn("new_section", F.col("pos") == 1)


def crawl_plan(pages: DataFrame, host: str, order: list[Column | str], delay: float) -> DataFrame:
    """Earliest start in seconds per page so that hosts are asked once per ``delay``."""
    placed = number_within(pages, [host], order, "_n")
    return placed.withColumn("earliest_s", (F.col("_n") - 1) * F.lit(float(delay))).drop("_n")
