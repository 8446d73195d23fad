"""Vector query: op3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.collisions import nearest_by_collisions
from newsflow.llm.queries import query, table


@query("op3_collision_neighbours")
def collision_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_by_collisions(table(spark, folder, "embeddings"), "vec_id", "embedding", every=20, k=20)
