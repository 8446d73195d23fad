"""One row per key: first, last, best; concatenation with priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank_in_key"


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` is cut down to one row per key and task before the shuffle, so
    a key with a large share of the rows costs one row per map task.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """The first ``n`` rows of each key; limited before the shuffle like ``first_per_key``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= n).drop(_RANK)


def first_per_text(df: DataFrame, text: str, order: Sequence[Column | str]) -> DataFrame:
    """As ``first_per_key`` for long texts: rows are compared by hash before by text."""
    return first_per_key(df, [F.xxhash64(text), F.col(text)], order)


def concat_first_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames one after the other; of rows with the same key the earliest frame's stays."""
    merged = None
    for priority, frame in enumerate(frames):
        part = frame.withColumn("_priority", F.lit(priority))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return first_per_key(merged, [key], ["_priority"]).drop("_priority")


def replace_group(df: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Rows of the groups present in ``new`` are replaced by ``new``."""
    kept = df.join(new.select(group).distinct(), group, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def id_set_differences(sent: DataFrame, received: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """Full comparison of sent and received keys: ``missing``, ``extra`` and ``moved`` rows.

    The n-th time a key was sent meets the n-th time it was received, so repeats multiply nothing.
    """
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(pos)).alias("_turn")
    s = sent.select(*key, F.col(pos).alias("sent_pos"), turn)
    r = received.select(*key, F.col(pos).alias("received_pos"), turn)
    status = (
        F.when(F.col("received_pos").isNull(), "missing")
        .when(F.col("sent_pos").isNull(), "extra")
        .when(F.col("sent_pos") != F.col("received_pos"), "moved")
        .otherwise("ok")
    )
    return s.join(r, [*key, "_turn"], "full_outer").drop("_turn").withColumn("status", status)
