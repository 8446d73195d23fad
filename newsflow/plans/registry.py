"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Reference time of derived document dates.
NOW = "2024-01-31 00:00:00"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result as SQL over the plain tables."""

    def add(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose long texts are worked on row by row."""
    return spread(table(spark, folder, name))


def now(spark: SparkSession | None = None):
    return F.to_timestamp(F.lit(NOW))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news items: title = first line, one per hour."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), "source", "lang", "text", "n_chars",
        F.substring_index("text", "\n", 1).alias("title"),
        (F.col("doc_id") % 240).alias("age_h"),
    )


# The same frame as a SQL expression.
ITEMS = (
    "(select doc_id as id, source, lang, text, n_chars, split_part(text, chr(10), 1) as title, "
    "doc_id % 240 as age_h from documents)"
)
