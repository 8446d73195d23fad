"""Items not seen before, as a stream over the growing history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators.dedup import first_per_key
from newsflow.operators.history import unseen_items
from newsflow.sources.sinks import history_rows


def stream_unseen(
    items: DataFrame, history_root: str, out: str, checkpoint: str, event_time: str = "published", trigger_once: bool = True,
) -> StreamingQuery:
    """Write the new items of a stream to ``out`` and record every new address in the history.

    ``items`` is a streaming frame with ``id``, ``url``, ``source``, ``title``, ``isAI`` and
    the event time. ``history_root`` holds the history as ``version=N`` folders, 0 being what was there
    before; batch N looks up all versions up to N and appends its own rows as version N + 1, so nothing is
    rewritten. Repeats inside a batch are dropped there, repeats of earlier batches are in the history, however
    late they come: there is no stream state and no watermark. A batch without rows writes nothing. A batch that runs
    again after a failure reads the same versions and overwrites its own output, so it leaves the same result.
    """
    # Items without a URL are never repeats of each other.
    own = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        stored = batch.sparkSession.read.parquet(history_root).filter(F.col("version") <= number).drop("version")
        rows = first_per_key(batch.withColumn("_key", own), ["_key"], [event_time, "id"]).drop("_key")
        unseen_items(rows, stored).write.mode("overwrite").parquet(f"{out}/batch={number}")
        gathered = history_rows(rows.filter("url <> ''"), rows.limit(0).withColumn("final_url", F.lit("")), F.col(event_time))
        fresh = gathered.join(stored.select("initial_url").distinct(), "initial_url", "left_anti")
        fresh.select(stored.columns).write.mode("overwrite").parquet(f"{history_root}/version={number + 1}")

    writer = items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
