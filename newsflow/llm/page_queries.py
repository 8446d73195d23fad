"""Page query: op6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.queries import query, table
from newsflow.llm.store import small_input
from newsflow.llm.tree_text import page_texts


@query("op6_tree_scored_text")
def tree_scored_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(small_input(table(spark, folder, "pages").select("page_id", "url", "html")))
