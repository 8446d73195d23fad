"""Toxicity of whole texts by the recurrent network of `recurrent`, fitted on a bounded sample of labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsflow.llm.recurrent import Network, fit_network
from newsflow.llm.words import slices

#: Labelled documents that the network is fitted on, at most, and bytes of text that a task scores at once.
FIT_ROWS, SLICE = 6_000, 1 << 18
FOLDS, HELD_OUT = 5, 0


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; the rows with 0 are never learned from."""
    return F.crc32(F.col(column).cast("string")) % FOLDS


def toxic_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled ids of the learning folds, up to half of them with label 1.

    Labels other than 0 and 1 and rows without an id or label don't count; of several labels of an id the largest
    does. The ids are those with the smallest hash; of rows that share an id the smallest text counts.
    """
    ids = (
        labels.select("doc_id", F.col("toxic").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold() != HELD_OUT))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = ids.filter("label = 1").orderBy(*order).limit(limit // 2)
    clean = ids.filter("label = 0").orderBy(*order).limit(limit - limit // 2)
    chosen = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(clean)), "doc_id")
    return chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", F.col("label").cast("int").alias("label"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, most_bytes: int = 64 << 20) -> Network:
    """A network for ``labels.toxic``. Texts come to the driver up to ``most_bytes`` together, shortest first."""
    rows = toxic_sample(docs, labels, limit).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    sizes = sorted(r["size"] for r in rows.select("size").collect())
    total, longest = 0, 0
    for size in sizes:
        total += size
        if total > most_bytes:
            break
        longest = size
    told = rows.filter(F.col("size") <= longest).select("text", "label").toArrow().sort_by([("text", "ascending"), ("label", "ascending")])
    return fit_network(told["text"].combine_chunks().cast(pa.large_string()) if len(told) else pa.array([], pa.large_string()), told["label"].to_numpy())


def toxicity_scores(docs: DataFrame, model: Network, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted, n_windows, worst_word) of every document; null and empty texts are scored as one empty window.

    All windows of a text are scored, overlapping by half or more; its score is that of the worst, which begins at worst_word.
    One row per input row, whatever the key holds; a null key is held out of nothing. Only ``text`` decides; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text, SLICE):
                n = stop - start
                score, windows, worst = net.texts(text.slice(start, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(windows), pa.array(worst)],
                    ["key", "score", "predicted", "n_windows", "worst_word"])

    told = StructType.fromDDL("score double, predicted int, n_windows long, worst_word long").fields
    scored = docs.select(F.col(key).alias("key"), "text").mapInArrow(judge, StructType([StructField("key", docs.schema[key].dataType), *told]))
    held = F.coalesce(fold("key") == HELD_OUT, F.lit(False)).alias("held_out")
    return scored.select(F.col("key").alias(key), held, "score", "predicted", "n_windows", "worst_word")
