"""Readers: tables by key or filter, ground truth files, feed and API items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import schema
from newsflow.operators.dedup import top_per_key


def read_table(spark: SparkSession, path: str, key: str | None = None, value=None) -> DataFrame:
    """A whole table, or the rows with one key (the filter reaches the parquet scan)."""
    df = spark.read.parquet(path)
    return df if key is None else df.filter(F.col(key) == value)


def rows_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for many keys at once."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def newest_filtered(df: DataFrame, required: Sequence[str], length: str, at_least: int, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows that carry the required texts and are long enough."""
    for name in required:
        df = df.filter(F.col(name).isNotNull() & (F.col(name) != ""))
    return df.filter(F.col(length) > at_least).orderBy(F.desc(key)).limit(n)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled headlines from CSV; quoted fields may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema.HEADLINE_TRUTH)
        .options(header=True, multiLine=True, escape='"').csv(path)
    )


def texts_by_path(df: DataFrame, texts: DataFrame, path: str = "text_path") -> DataFrame:
    """Texts attached by path; rows with an empty path or text are left out.

    ``texts`` has ``path`` and ``text``, e.g. from :func:`read_text_files`.
    """
    # Fixed value: the path of an item that was saved without a name.
    unnamed = "download/text/.txt"
    wanted = df.filter((F.coalesce(F.col(path), F.lit("")) != "") & (F.col(path) != unnamed))
    joined = wanted.join(texts.select(F.col("path").alias(path), F.col("text")), path, "left")
    return joined.filter(F.length(F.coalesce(F.col("text"), F.lit(""))) > 0)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file under ``folder``; files that vanish or are broken are passed over."""
    return (
        spark.read.options(ignoreMissingFiles=True, ignoreCorruptFiles=True)
        .text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )


def feed_items(entries: DataFrame, per_source: int = 50) -> DataFrame:
    """Feed entries as items: the first ``per_source`` of each feed, in feed order."""
    first = top_per_key(entries, ["source"], ["ord"], per_source)
    detail = F.coalesce(F.col("title_detail"), F.lit(""))
    title = F.coalesce(F.col("title"), F.lit(""))
    return first.select(
        "ord", "source",
        F.when((detail != "") & (detail != title), F.concat(title, F.lit(": "), detail)).otherwise(title).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("published", F.lit("")).alias("published"),
        F.coalesce(F.nullif("summary", F.lit("")), "description", F.lit("")).alias("rss_summary"),
    )


def api_items(bodies: DataFrame, body: str, source: str) -> DataFrame:
    """Items of news API responses: the ``articles`` array of each JSON body."""
    parsed = F.from_json(F.col(body), "struct<articles:array<struct<title:string,url:string,publishedAt:string>>>")
    blank = F.lit("")
    return bodies.select("ord", F.posexplode(parsed["articles"]).alias("pos", "a")).select(
        "ord", "pos", F.lit(source).alias("source"),
        F.coalesce("a.title", blank).alias("title"), F.coalesce("a.url", blank).alias("url"),
        F.coalesce("a.publishedAt", blank).alias("published"),
    )


def gather(catalog: DataFrame, frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Items of all source types, and the sources that gave nothing.

    ``frames`` maps a source type to the items of that type; a type without a frame is an
    error for all its sources. Returns ``(items, failed)``.
    """
    items = None
    for kind, frame in frames.items():
        named = catalog.filter(F.col("type") == kind).select(F.col("name").alias("source"))
        part = frame.join(named, "source", "left_semi")
        items = part if items is None else items.unionByName(part, allowMissingColumns=True)
    produced = items.select(F.col("source").alias("name")).distinct()
    reason = F.when(F.col("type").isin(*frames), "no items").otherwise("unknown type")
    failed = catalog.join(produced, "name", "left_anti").select("name", "type", reason.alias("reason"))
    return items, failed


def newest_until(posts: DataFrame, marker: str | None, now, max_age_hours: float = 30) -> DataFrame:
    """Posts newest first up to, but without, the first one equal to ``marker``.

    ``posts`` has ``ord`` (0 = newest), ``ts`` and ``text``. Posts older than the limit are
    left out one by one.
    """
    recent = posts.filter(F.col("ts") >= now - F.make_interval(hours=F.lit(int(max_age_hours))))
    if marker is None:
        return recent
    cut = posts.filter(F.col("text") == marker).select(F.min("ord")).scalar()
    return recent.filter(cut.isNull() | (F.col("ord") < cut))


def reorder(df: DataFrame, index: str, wanted: DataFrame, listed: str) -> DataFrame:
    """Rows in the order of a list of indexes; rows that are not listed are left out.

    ``wanted`` may hold several lists; its other columns say which, and each list is an order of its own.
    """
    which = [c for c in wanted.columns if c != listed]
    positions = wanted.select(*which, F.posexplode(listed).alias("pos", index))
    return positions.join(df, index).orderBy(*which, "pos")
