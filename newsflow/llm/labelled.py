"""A bounded sample of labelled texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_OUT = 1
FOLDS = 3


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; the rows with 1 are never learned from."""
    return F.crc32(F.col(column).cast("string")) % FOLDS


def labelled_texts(docs: DataFrame, labels: DataFrame, limit: int, target: str = "quality") -> DataFrame:
    """(text, label) of at most ``limit`` labelled ids of the learning folds.

    Labels other than 0 and 1 and rows without an id or label don't count; an id with
    several labels has the smallest. The ids are those with the smallest hash, so that the same
    rows are chosen every time. Of rows that share an id the smallest text counts, so that ``limit`` bounds
    what is sent to every task and to the driver.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(target).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold() != HELD_OUT))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", F.col("label").cast("int").alias("label"))
