"""Classifier evaluation, log analytics and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.scores import duration_text
from newsflow.functions.text import redact_secrets


def compare(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions of each model next to the truth of the same input."""
    return predictions.withColumnRenamed("output", "pred").join(truth.withColumnRenamed("output", "truth"), "input")


def accuracy(compared: DataFrame) -> DataFrame:
    right = (F.col("pred") == F.col("truth")).cast("int")
    return compared.groupBy("model").agg(
        F.avg(right.cast("double")).alias("accuracy"), F.sum(right).alias("n_correct"), F.count(F.lit(1)).alias("n")
    )


def confusion(compared: DataFrame) -> DataFrame:
    return compared.groupBy("model", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def wrong(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("pred") != F.col("truth"))


def common_errors(compared: DataFrame, top: int = 10) -> DataFrame:
    """Inputs that several models got wrong, most models first."""
    return (
        wrong(compared).groupBy("input").agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("model")).alias("models"),
            F.array_sort(F.collect_set("pred")).alias("preds"),
        )
        .filter("n > 1").orderBy(F.desc("n"), "input").limit(top)
    )


def log_stats(logs: DataFrame, session: str, level: str, step: str, ts: str) -> DataFrame:
    """Counts per session by level, by step and in total, with the time range, in one pass.

    ``part`` tells which of the three a row belongs to; rows without a step are left out of
    the step counts.
    """
    part = F.when(F.grouping(F.col(level)) == 0, "level").when(F.grouping(F.col(step)) == 0, "step").otherwise("all")
    sets = [[F.col(session), F.col(level)], [F.col(session), F.col(step)], [F.col(session)]]
    out = logs.groupingSets(sets, F.col(session), F.col(level), F.col(step)).agg(
        part.alias("part"), F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    return out.filter((F.col("part") != "step") | F.col(step).isNotNull())


def find_logs(logs: DataFrame, limit: int, session=None, step=None, level=None, key: str = "id") -> DataFrame:
    """Newest log rows; each condition applies only if it is given."""
    for column, value in (("agent_session", session), ("step_name", step), ("level", level)):
        if value is not None:
            logs = logs.filter(F.col(column) == value)
    return logs.orderBy(F.desc(key)).limit(limit)


def redact_logs(logs: DataFrame, message: str = "message") -> DataFrame:
    return logs.withColumn(message, redact_secrets(message))


def step_durations(runs: DataFrame, start: str, end: str) -> DataFrame:
    return runs.withColumn("duration", duration_text(start, end))


def fetch_records(pages: DataFrame, ok, body: str, columns: list[str]) -> DataFrame:
    """One row per item: ``columns``, ``status`` (success or failed) and ``file_size_bytes``, 0 where nothing was stored.

    A null verdict is a failure, as is a missing body; an empty body that was stored counts as a success of size 0.
    """
    stored = F.coalesce(ok, F.lit(False)) & F.col(body).isNotNull()
    return pages.select(
        *columns, F.when(stored, "success").otherwise("failed").alias("status"),
        F.when(stored, F.octet_length(body)).otherwise(0).cast("long").alias("file_size_bytes"))


def fetch_summary(pages: DataFrame, ok, body: str) -> DataFrame:
    return pages.agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.octet_length(body))), F.lit(0)).alias("total_bytes"),
    )
