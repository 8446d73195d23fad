"""Table statistics, scaling, counts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - mean) / population deviation over the whole table, 0 when the deviation is 0."""
    mean = df.select(F.avg(column)).scalar()
    deviation = df.select(F.stddev_pop(column)).scalar()
    return df.withColumn(out, F.when(deviation > 0, (F.col(column) - mean) / deviation).otherwise(0.0))


def add_minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to 0..1 over the whole table, 0.5 when all values are equal."""
    low = df.select(F.min(column)).scalar()
    span = df.select(F.max(column) - F.min(column)).scalar()
    return df.withColumn(out, F.when(span == 0, 0.5).otherwise((F.col(column) - low) / span))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def coverage(df: DataFrame, columns: Sequence[str], rating: str, good: float = 7.0) -> DataFrame:
    """One row: how many rows carry each column, and the range of the rating."""
    present = [
        F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"with_{c}") for c in columns
    ]
    return df.agg(
        F.count(F.lit(1)).alias("n"), *present,
        F.min(rating).alias("min_rating"), F.max(rating).alias("max_rating"),
        F.avg(rating).alias("mean_rating"), F.count_if(F.col(rating) >= good).alias("n_good"),
    )


def cluster_sizes(df: DataFrame, label: str, noise: int = -1) -> DataFrame:
    """Number and sizes of the clusters and the share of noise, in one row."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(label) != noise
    size = F.when(real, F.col("n"))
    return sizes.agg(
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"),
        (F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_ratio"),
        F.avg(size).alias("avg_size"), F.stddev_pop(size).alias("std_size"),
        F.min(size).alias("min_size"), F.max(size).alias("max_size"),
    )


def topic_frequency(df: DataFrame, topics: str, at_least: int = 3, top: int = 50) -> DataFrame:
    return (
        df.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= at_least).orderBy(F.desc("n"), "topic").limit(top)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Newest row of each key; ``order`` lists ascending columns, the last row wins."""
    fields = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*fields), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def newest_sessions(
    df: DataFrame, session: str, updated: str, since: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Distinct sessions by last update, newest first."""
    if since is not None:
        df = df.filter(F.col(updated) > since)
    out = df.groupBy(session).agg(F.max(updated).alias("last_update")).orderBy(F.desc("last_update"), session)
    return out if limit is None else out.limit(limit)


def progress(df: DataFrame, status: str) -> DataFrame:
    """Counts per step status with the share of completed steps in percent."""
    done = df.select(100.0 * F.avg((F.col(status) == "completed").cast("double"))).scalar()
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).withColumn("progress", done)


def moving_changes(rounds: DataFrame, order: str, change: str) -> DataFrame:
    """Mean of the last two and of the two rounds before, per round of a tournament log."""
    window = Window.orderBy(order)  # one row per round
    pair = F.avg(change).over(window.rowsBetween(-1, 0))
    return rounds.withColumn("last_two", pair).withColumn("prev_two", F.lag("last_two", 2).over(window))
