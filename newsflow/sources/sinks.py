"""Keyed upserts, deletes, history rows, exports and step snapshots.

There is no table format with row-level updates here, so an upsert is a join of the stored
version with the changes, written as a new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.dedup import first_per_key
from newsflow.operators.numbering import number_within


def upsert(
    stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Stored rows overwritten by changed rows with the same key, new keys inserted.

    Of several changes for one key the first in ``order`` counts (newest first). Columns in
    ``keep`` retain the stored value where there is one. Both sides have one row per key
    when they meet, so no key is heavier than another.
    """
    if order:
        changes = first_per_key(changes, keys, order)
    old = stored.withColumn("_old", F.lit(True)).alias("o")
    new = changes.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]

    def pick(name: str) -> Column:
        if name in keys:
            return F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}"))
        if name not in changes.columns:
            return F.col(f"o.{name}")
        if name in keep:
            return F.coalesce(F.col(f"o.{name}"), F.col(f"n.{name}"))
        return F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    return old.join(new, on, "full_outer").select(*[pick(c).alias(c) for c in stored.columns])


def delete_keys(stored: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return stored.join(keys.select(*on).distinct(), list(on), "left_anti")


def deleted_per_group(stored: DataFrame, keys: DataFrame, on: Sequence[str], group: str) -> DataFrame:
    """How many rows a delete removes, per group."""
    gone = stored.join(keys.select(*on).distinct(), list(on), "left_semi")
    return gone.groupBy(group).agg(F.count(F.lit(1)).alias("n_deleted"))


def history_rows(gathered: DataFrame, downloaded: DataFrame, now: Column) -> DataFrame:
    """One history row per gathered URL; the final URL is known for downloaded ones only.

    A downloaded item without a final URL keeps its own address, one that was never
    downloaded gets ''.
    """
    done = downloaded.select(
        F.col("url").alias("_durl"),
        F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")).alias("final_url"),
    )
    done = first_per_key(done, ["_durl"], ["final_url"])
    return gathered.join(done, F.col("url") == F.col("_durl"), "left").select(
        F.col("url").alias("initial_url"), F.coalesce("final_url", F.lit("")).alias("final_url"),
        "title", "source", F.coalesce("isAI", F.lit(False)).alias("isAI"), now.alias("created_at"),
    )


def write_history(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """History with the rows upserted, one per URL; the time a URL was first seen is kept.

    Of several rows for one URL the newest counts, of these the one with the largest final URL, then one marked as AI,
    then the largest title and source.
    """
    newest = [F.desc(c) for c in ("created_at", "final_url", "isAI", "title", "source")]
    return upsert(stored, rows, ["initial_url"], newest, keep=["created_at"])


def article_rows(df: DataFrame, defaults: Mapping[str, object], casts: Mapping[str, str], now: Column) -> DataFrame:
    """Rows ready for the article table: defaults filled, types cast, topics joined."""
    from newsflow.functions.arrays import topics_to_text

    out = df.withColumns({
        name: F.coalesce(F.col(name).cast(casts.get(name, dict(df.dtypes)[name])), F.lit(value))
        for name, value in defaults.items()
    })
    if "topics" in df.columns:
        out = out.withColumn("topics", F.coalesce(topics_to_text("topics"), F.lit("")))
    if "date" in df.columns:
        out = out.withColumn("date", F.coalesce("date", now))
    return out


def group_json(df: DataFrame, group: str, order: Sequence[Column | str], fields: Mapping[str, str]) -> DataFrame:
    """Rows of each group as JSON objects in order: ``(group, pos, json)``.

    One object per row and not one array per group, so a large group stays many rows;
    written with ``partitionBy(group)`` each group is its own set of JSON lines.
    """
    record = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in fields.items()]))
    return number_within(df, [group], order, "pos").select(group, "pos", record.alias("json"))


def document_lines(
    df: DataFrame, section_order: str, section: str, story_order: Sequence[Column | str], line: Column
) -> DataFrame:
    """The rendered document as ordered lines: a header when the section changes, then bullets.

    Ordered output rows ``(section_order, pos, line)``; position 0 is the header. Writing
    them sorted gives the text file without holding a section in one row.
    """
    placed = number_within(df, [section_order], story_order, "pos")
    body = placed.select(section_order, "pos", line.alias("line"))
    headers = placed.filter("pos = 1").select(
        section_order, F.lit(0).cast("long").alias("pos"), F.concat(F.lit("## "), F.col(section)).alias("line")
    )
    return headers.unionByName(body.withColumn("pos", F.col("pos").cast("long")))


def write_document(lines: DataFrame, section_order: str, path: str) -> None:
    lines.orderBy(section_order, "pos").select("line").write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, root: str, session: str, step: str) -> None:
    """Output of one step of one session; a repeated step replaces its own snapshot."""
    df.write.mode("overwrite").parquet(f"{root}/session={session}/step={step}")


def read_snapshot(spark: SparkSession, root: str, session: str | None = None, step: str | None = None) -> DataFrame:
    """Snapshots under ``root``; the filters prune folders."""
    df = spark.read.option("mergeSchema", "true").parquet(root)
    if session is not None:
        df = df.filter(F.col("session") == session)
    return df if step is None else df.filter(F.col("step") == step)


def append_trial(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_trial(spark: SparkSession, path: str) -> DataFrame:
    trials = spark.read.parquet(path)
    return trials.agg(F.max_by(F.struct("*"), "timestamp").alias("t")).select("t.*")
