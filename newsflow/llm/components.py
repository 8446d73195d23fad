"""Connected components of a link table: union-find inside tasks, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.store import drop, written


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as a forest of depth one: every node with the smallest it is linked to."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(place[:len(a)].tolist(), place[len(a):].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))], np.int64)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, move to the smallest. Links point from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link and no root has any: then the links are the answer."""
    children = links.groupBy("a").agg(F.count("*").alias("n"))
    if not children.filter("n > 1").isEmpty():
        return False
    return links.join(children.select(F.col("a").alias("child")), F.col("b") == F.col("child"), "left_semi").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long) that is not itself the smallest of its component, with the smallest.

    Repeated links, loops and both directions are allowed; links with a null don't count. An empty
    table has no nodes. Only the smallest neighbour is kept per node and task before a shuffle; the rows of
    a hub are spread by the join on it, which Spark splits. Each round writes its links as a table and
    deletes the one before. Raises if ``most_rounds`` are not enough (rounds grow with the logarithm of the nodes).
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = written(links.mapInArrow(_union_find, "a long, b long").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, now = now, written(_small_star(_large_star(now)), "links")
        drop(before)
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
