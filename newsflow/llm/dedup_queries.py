"""Duplicate queries: op4 and op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.near_duplicates import near_duplicates
from newsflow.llm.queries import query, table
from newsflow.llm.repeats import remove_repeats


@query("op5_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


@query("op4_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
