"""Connected components and spanning trees of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` with the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on the edge list:
    the number of rounds grows with the logarithm of the diameter, and the edge list never
    grows. Each round's edges are written out.
    """
    stars = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    previous = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
            .unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
            .filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
        stars = cut_lineage(small)
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    joined = nodes.select("node").join(stars.select(F.col("a").alias("node"), F.col("b").alias("comp")), "node", "left")
    return joined.select("node", F.coalesce("comp", "node").alias("comp"))


def minimum_spanning_edges(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Boruvka: per round every component takes its lightest edge to another one.

    ``nodes`` has ``node``; ``edges`` has ``a``, ``b``, ``w``. Ties are broken by the ends.
    """
    comp = nodes.select("node", F.col("node").alias("comp"))
    taken = None
    left = edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"))
    for _ in range(max_rounds):
        sides = left.select(F.col("a").alias("c"), "w", "x", "y").unionByName(
            left.select(F.col("b").alias("c"), "w", "x", "y"))
        best = sides.groupBy("c").agg(F.min(F.struct("w", "x", "y")).alias("e")).select("c", "e.*")
        best = cut_lineage(best.select("w", "x", "y").distinct())
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
        lookup = comp.select(F.col("node"), "comp")
        ends = (
            best.join(lookup.select(F.col("node").alias("x"), F.col("comp").alias("a")), "x")
            .join(lookup.select(F.col("node").alias("y"), F.col("comp").alias("b")), "y").select("a", "b")
        )
        joined = connected_components(comp.select(F.col("comp").alias("node")).distinct(), ends).withColumnRenamed("comp", "_to")
        comp = cut_lineage(comp.join(joined.withColumnRenamed("node", "comp"), "comp").select("node", F.col("_to").alias("comp")))
        to = joined.select("node", "_to")
        left = cut_lineage(
            left.join(to.select(F.col("node").alias("a"), F.col("_to").alias("_a")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("_to").alias("_b")), "b")
            .filter(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w", "x", "y")
            .groupBy("a", "b").agg(F.min(F.struct("w", "x", "y")).alias("e")).select("a", "b", "e.*")
        )
    else:
        raise RuntimeError("spanning tree did not settle")
    if taken is None:
        return nodes.sparkSession.createDataFrame([], "a long, b long, w double")
    return taken.select(F.col("x").alias("a"), F.col("y").alias("b"), "w").distinct()
