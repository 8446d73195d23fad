"""Row numbers without a single-task window.

A window without a partition key, or one whose key holds a large share of the rows,
sends those rows to one task. Here the rows are range-partitioned on the full sort key,
numbered inside each partition, and shifted by the rows in front of the partition. The
sort key must end in a unique column, which also splits runs of equal values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.session import pin_partitions


def _order(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "row_number") -> DataFrame:
    """``out`` = 1..n in the order of ``order``."""
    keys = _order(order)
    # The checkpoint fixes the sampled range bounds: both reads below see the same partitions.
    ranged = pin_partitions(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = ranged.withColumn("_mono", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_mono", 33)
    )
    # One row per partition, so the running sum and the broadcast are bounded by their number.
    before = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_before"))
    )
    local = F.col("_mono") - F.shiftleft("_part", 33)
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(out, local + F.col("_before") + 1)
        .drop("_part", "_mono", "_before")
    )


def number_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str = "row_number"
) -> DataFrame:
    """``out`` = 1..n inside each group; a group may be larger than one task can hold."""
    group = list(group)
    keys = _order(order)
    ranged = pin_partitions(df.repartitionByRange(*_order(group), *keys))
    placed = ranged.withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part", *group).orderBy(*keys)
    # Only the first group of a partition can have rows in earlier partitions, so at most
    # one carried count per partition remains and is safe to broadcast.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carry", F.sum("_n").over(earlier))
        .filter("_carry > 0")
        .select(F.col("_part").alias("_cpart"), *[F.col(g).alias(f"_c_{g}") for g in group], "_carry")
    )
    same = F.col("_part") == F.col("_cpart")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    return (
        placed.withColumn("_local", F.row_number().over(within))
        .join(F.broadcast(carried), same, "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_part", "_local", "_cpart", "_carry", *[f"_c_{g}" for g in group])
    )


def chunk_rows(df: DataFrame, order: Sequence[Column | str], size: int = 25, out: str = "chunk") -> DataFrame:
    """Consecutive chunks of ``size`` rows, numbered from 0."""
    numbered = number_rows(df, order, "_rn")
    return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def rank_change(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """Sum and mean of the absolute rank differences of two rankings."""
    moved = F.abs(F.col("a") - F.col("b"))
    return (
        # By shuffle: both sides have all rows, however small their files are.
        before.select(key, F.col(rank).alias("b")).join(after.select(key, F.col(rank).alias("a")).hint("merge"), key)
        .agg(F.sum(moved).alias("total_change"), F.avg(moved).alias("mean_change"))
    )


def positional_seed(rank: Column | str, n: Column | int) -> Column:
    """Evenly spaced from 1 for rank 1 to 0 for rank n."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    n = F.lit(n) if isinstance(n, int) else n
    return 1 - (rank - 1) / (n - 1)
