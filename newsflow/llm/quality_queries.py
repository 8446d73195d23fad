"""Quality queries: op8, op10 and op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.boosted import fit_quality_rules, quality_rules
from newsflow.llm.pairwise import fit_quality, quality_scores
from newsflow.llm.queries import query, table
from newsflow.llm.store import small_input
from newsflow.llm.toxicity import fit_toxicity, toxicity_scores


@query("op8_quality_ranking")
def quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_scores(small_input(docs.select("doc_id", "text")), fit_quality(docs, table(spark, folder, "labels")))


@query("op10_quality_rules")
def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules(small_input(docs.select("doc_id", "text")), fit_quality_rules(docs, table(spark, folder, "labels")))


@query("op11_toxicity_windows")
def toxicity_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity_scores(small_input(docs.select("doc_id", "text")), fit_toxicity(docs, table(spark, folder, "labels")))
