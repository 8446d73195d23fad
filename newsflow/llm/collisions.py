"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are dealt into blocks. A block's index holds, for each of a fixed set of projections, its vectors
sorted by their projection. A query takes the projections in which it lies farthest from the block's middle, as those tell near
vectors from others best, and opens a window around its own place in each of their sorted arrays; a vector inside collides.
Windows widen step by step (virtual rehashing: the arrays stay, only the windows grow) until enough vectors collide in the
share of projections that a near vector is expected to reach; these are verified by their exact product. Widths at which all
windows together hold too few entries for that are passed over without counting.

Largest inner product becomes smallest distance by one more component, sqrt(M**2 - |x|**2), M the block's largest
norm; a query has 0 there and length M. Projections
are the rows of random orthogonal matrices, whose collision counts vary less than independent ones.
Every block is searched for every query, so a query misses a neighbour only if that
falls short of the collision threshold of its block; the result of all blocks is merged by an aggregation. The work is
proportional to queries times vectors, with a small factor: per query and vector about ten window entries and a tenth of a product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.store import written

#: Vectors per block at most about, values per block, random orthogonal bases.
BLOCK, VALUES, BASES = 16_384, 2**21, 3
#: Projections that a query takes, and the share of them that makes a candidate.
TAKEN, SHARE = 24, 0.6
#: Windows widen until so many vectors of a block are candidates: a floor, and a share of the block.
FLOOR, CANDIDATES = 128, 0.04
#: Half widths of the windows, in units of a projection's standard deviation in the block.
STEPS = np.arange(0.5, 9.0, 0.25)
#: Queries whose windows are looked up together.
TOGETHER = 512

_NAMES = ["target", "ids", "vectors"]


def bases(dim: int, count: int) -> np.ndarray:
    """(dim, dim * count) orthonormal columns, the same every time."""
    draw = np.random.Generator(np.random.PCG64(20240607))
    return np.hstack([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(count)])


def deal_blocks(vectors: DataFrame, dim: int, count: int) -> tuple[DataFrame, int]:
    """The written blocks (target, ids, vectors) of (id, vector) rows, one row each, and their number.

    Dealt in turn, so that copies spread over all blocks. Written, as a row's place in its block names it.
    """
    size = min(BLOCK, max(512, VALUES // (dim + 1)))
    dealt = vectors.repartition(max(1, -(-count // size)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            vectors = np.concatenate([b.column("vector").flatten().cast(pa.float64()).to_numpy() for b in held])
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[0].column("part")[0].as_py()], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], _NAMES)

    packed = dealt.select(F.spark_partition_id().alias("part"), "id", "vector").mapInArrow(gather, "target int, ids binary, vectors binary")
    blocks = written(packed, "blocks")
    return blocks, blocks.agg(F.max("target")).first()[0] + 1


class Block:
    """One block's sorted projections and their search."""

    def __init__(self, target: int, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray) -> None:
        self.target, self.ids, self.vectors, self.axes = target, ids, vectors, axes
        norms = np.square(vectors).sum(axis=1)
        self.longest = float(np.sqrt(norms.max()))
        # Where squares overflow nothing can be told apart: all are verified.
        self.enough = min(len(ids), FLOOR + int(CANDIDATES * len(ids))) if np.isfinite(self.longest) else len(ids)
        if self.enough == len(ids):
            return
        places = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]) @ axes
        self.middle, self.spread = places.mean(axis=0), places.std(axis=0) + 1e-30
        order = np.argsort(places, axis=0, kind="stable")
        self.places = np.ascontiguousarray(np.take_along_axis(places, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))

    def _windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's projections, and where its windows begin and end in them: (query, projection, step)."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        centre = np.column_stack([queries * (self.longest / length), np.zeros(len(queries))]) @ self.axes
        taken = min(TAKEN, len(self.order))
        chosen = np.sort(np.argsort(-np.abs(centre - self.middle) / self.spread, axis=1, kind="stable")[:, :taken], axis=1)
        low = np.zeros((len(queries), taken, len(STEPS)), np.int64)
        high = np.zeros_like(low)
        for j in np.unique(chosen):
            q, slot = np.nonzero(chosen == j)
            half = STEPS * self.spread[j]
            low[q, slot] = self.places[j].searchsorted(centre[q, j, None] - half)
            high[q, slot] = self.places[j].searchsorted(centre[q, j, None] + half, "right")
        return chosen, low, high

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the vectors that collide in at least SHARE of its projections, at the first width that has enough of them."""
        n = len(self.ids)
        if self.enough == n:
            yield from (np.arange(n) for _ in queries)
            return
        for first in range(0, len(queries), TOGETHER):
            chosen, low, high = self._windows(queries[first:first + TOGETHER])
            least = int(np.ceil(SHARE * chosen.shape[1]))
            entries = (high - low).sum(axis=1)
            for js, begin, end, held in zip(chosen, low, high, entries):
                own = [self.order[j] for j in js]
                step = int(held.searchsorted(least * self.enough))
                counts, found = np.zeros(n, np.int64), np.arange(n)
                inner = outer = None
                while step < len(STEPS):
                    a, b = begin[:, step].tolist(), end[:, step].tolist()
                    if inner is None:
                        rings = [o[x:y] for o, x, y in zip(own, a, b)]
                    else:
                        rings = [o[x:y] for o, x, y in zip(own, a, inner)] + [o[x:y] for o, x, y in zip(own, outer, b)]
                    inner, outer = a, b
                    counts += np.bincount(np.concatenate(rings), minlength=n)
                    met = np.flatnonzero(counts >= least)
                    if len(met) >= self.enough:
                        found = met
                        break
                    step += 1
                yield found

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and products of the k best candidates; ``own`` are the queries' places in this block, or -1."""
        for query, place, found in zip(queries, own, self.candidates(queries)):
            found = found[found != place]
            # A sum per row in a fixed order: equal vectors get equal products.
            score = (self.vectors[found] * query).sum(axis=1)
            if len(found) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[near], score[near]
            best = np.lexsort((self.ids[found], -score))[:k]
            yield self.ids[found[best]], score[best]


def nearest_by_collisions(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors with the largest inner product, for each row whose id is divisible by ``every``.

    All other rows are candidates, also those with equal vectors or the query's id. Rows with a null id, a null or zero vector or one
    with null or non-finite components take no part, nor vectors of another length than the most frequent (of equally frequent ones
    the longest). Ties go to the smaller id; fewer candidates than k give fewer rows; no vectors give no rows. Products are sums of
    double products. Other columns are not read.
    """
    v = F.col(vector_column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector"))
    told = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "query_id long, row long, vec_id long, score double"
    if told is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = told["dim"]
    dealt, blocks = deal_blocks(rows.filter(F.size("vector") == dim), dim, told["n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x = np.frombuffer(batch.column("vectors")[i].as_py(), float).reshape(-1, dim)
                    values = [[batch.column("target")[i].as_py()], [ids[at].tobytes()], [at.tobytes()], [x[at].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(values, (pa.int32(), *[pa.binary()] * 3))], ["home", "ids", "places", "vectors"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, block = bases(dim + 1, BASES), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], float).reshape(-1, dim)
                home = row["home"]
                if home == -1:
                    block = Block(row["target"], ids, vectors, axes)
                    continue
                if block is None or block.target != row["target"]:
                    continue  # an empty block
                places = np.frombuffer(row["places"], np.int64)
                own = places if home == block.target else np.full(len(ids), -1)
                out = list(block.nearest(vectors, own, k))
                sizes = [len(found) for found, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(places + (home << 32), sizes)),
                     pa.array(np.concatenate([found for found, _ in out])), pa.array(np.concatenate([score for _, score in out]))], ["query_id", "row", "vec_id", "score"])

    # Every block first, then all query blocks, one after the other: a task holds one block and one block of queries.
    asked = dealt.mapInArrow(ask, "home int, ids binary, places binary, vectors binary")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("target"), "ids", "vectors", "home", "places")
    met = dealt.withColumns({"home": F.lit(-1), "places": F.lit(None).cast("binary")}).unionByName(sent).repartition(blocks, "target").sortWithinPartitions("target", "home")
    found = met.mapInArrow(search, schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
