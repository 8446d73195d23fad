"""Diverse top-k by maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.operators.dedup import concat_first_wins
from newsflow.session import cut_lineage

POOL = 1024


def mmr_select(
    df: DataFrame, embeddings: DataFrame, n: int = 100, weight: float = 0.5, key: str = "id",
    rating: str = "rating", vec: str = "embedding", pool: int = POOL,
) -> DataFrame:
    """``n`` rows that balance rating and difference from the rows already picked, with ``pick``.

    The score of a candidate is ``weight`` times its rating scaled to 0..1 plus
    ``1 - weight`` times one minus its highest cosine to a picked row. The score of a
    candidate can only fall as rows are picked. A pass over the table therefore fetches
    the ``pool`` best candidates, and picks are made among them for as long as the best one
    stays above the score the first candidate outside the pool had: the result is that of
    one pass per pick, with a fraction of the passes. The driver holds ``pool`` vectors.
    A row without a vector has cosine 0 to every other row.
    """
    if n <= 0:
        return df.limit(0).withColumn("pick", F.lit(0))
    if df.limit(n + 1).count() <= n:
        return df.withColumn("pick", F.lit(None).cast("int"))
    low, high = df.agg(F.min(rating), F.max(rating)).first()
    scaled = F.lit(0.5) if high == low else (F.col(rating) - float(low)) / float(high - low)
    width = embeddings.agg(F.max(F.size(vec))).first()[0] or 1
    zero = F.array_repeat(F.lit(0.0), width)
    base = cut_lineage(
        df.select(key, F.col(rating).cast("double").alias("_rating"), scaled.cast("double").alias("_rel"))
        .join(embeddings.select(key, F.col(vec).cast("array<double>").alias("_vec")), key, "left")
        .withColumn("_vec", F.coalesce("_vec", zero))
    )
    first = base.orderBy(F.desc("_rating"), key).select(key, "_vec").first()
    picks: list = [first[0]]
    picked_vecs: list[np.ndarray] = [_unit(first[1])]
    while len(picks) < n:
        candidates = _best(base.filter(~F.col(key).isin(picks)), picked_vecs, weight, key, pool + 1)
        if not candidates:
            break
        outside = candidates[pool]["_score"] if len(candidates) > pool else -np.inf
        inside = candidates[:pool]
        _pick_from(inside, outside, picks, picked_vecs, n, weight, key)
    order = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(picks)) for x in pair])
    return df.filter(F.col(key).isin(picks)).withColumn("pick", order[F.col(key)])


def _unit(vec) -> np.ndarray:
    v = np.asarray(vec, dtype=np.float64)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _best(base: DataFrame, picked: list[np.ndarray], weight: float, key: str, n: int) -> list:
    """The ``n`` highest current scores, by one scan with a bounded matrix of picked vectors."""
    chosen = np.stack(picked)

    @F.pandas_udf(T.DoubleType())
    def closeness(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype="float64")
        x = np.stack(vecs.to_numpy())
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series((x / np.where(norms == 0, 1, norms) @ chosen.T).max(axis=1))

    scored = base.withColumn("_sim", closeness("_vec"))
    score = weight * F.col("_rel") + (1 - weight) * (1 - F.col("_sim"))
    return scored.withColumn("_score", score).orderBy(F.desc("_score"), key).limit(n).collect()


def _pick_from(inside, outside, picks, picked_vecs, n, weight, key) -> None:
    """Picks among the fetched candidates while no unfetched one can be better."""
    keys = [r[key] for r in inside]
    rel = np.array([r["_rel"] for r in inside])
    sim = np.array([r["_sim"] for r in inside])
    vecs = np.stack([_unit(r["_vec"]) for r in inside])
    alive = np.ones(len(inside), dtype=bool)
    fresh = True
    while len(picks) < n and alive.any():
        score = np.where(alive, weight * rel + (1 - weight) * (1 - sim), -np.inf)
        top = score.max()
        if not fresh and top <= outside:
            return
        ties = [i for i in np.flatnonzero(score == top)]
        best = min(ties, key=lambda i: keys[i])
        alive[best] = False
        fresh = False
        picks.append(keys[best])
        picked_vecs.append(vecs[best])
        sim = np.maximum(sim, vecs @ vecs[best])


def tiered_select(
    df: DataFrame, embeddings: DataFrame, total: int = 100, must: float = 8.0, weight: float = 0.5,
    key: str = "id", rating: str = "rating", vec: str = "embedding",
) -> DataFrame:
    """All rows rated above ``must``, filled up to ``total`` with a diverse choice of the rest.

    Without any vectors the rest is filled by rating.
    """
    top = df.filter(F.col(rating) > must)
    rest = df.filter(F.col(rating) <= must)
    room = total - top.count()
    if room > 0 and embeddings.isEmpty():
        fill = rest.orderBy(F.desc(rating), key).limit(room)
    else:
        fill = mmr_select(rest, embeddings, room, weight, key, rating, vec).drop("pick")
    return concat_first_wins([top, fill], key)
