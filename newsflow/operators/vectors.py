"""Exact neighbour searches over unit vectors without a full cross product.

Vectors are assigned to the nearest of a bounded number of pivots (a Voronoi cell) and
only visit other cells that their search radius reaches: a point whose distance to the
plane between two pivots exceeds the radius has no partner on the other side. Cells are
cut into chunks of at most about ``BLOCK`` rows, and a task compares one chunk with one chunk, tile by tile
of ``CHUNK`` rows, using matrix products. Rows are sent once per chunk they meet, so large chunks keep what is
shuffled small; tiles keep a task's memory small. Copies of a vector are merged beforehand, so they are never compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.operators.skew import hot_keys, salted_join

CHUNK = 2048  # rows of a side that are compared at once
BLOCK = 16384  # rows of a side that a task holds
SPREAD = 8  # chunks of a side where rows are few, so that all cores have work
MAX_PIVOTS = 512
_VISITS = 1024  # rows that are assigned at once
_SENT = 4096  # rows that leave a task at once
_SLACK = 1e-6


def l2_normalise(vec: Column | str) -> Column:
    """Vector divided by its length; a zero vector stays as it is."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    squares = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.when(squares == 0, 1.0).otherwise(F.sqrt(squares))
    # Bound to an outer variable, the length is computed once and not once per component.
    return bind(norm, lambda n: F.transform(vec, lambda x: x.cast("double") / n))


def merge_copies(df: DataFrame, key: str, vec: str) -> DataFrame:
    """One row per distinct vector: ``(vid, vec, copies)`` with the smallest id of the copies."""
    return (
        df.filter(F.size(vec) > 0).groupBy(F.col(vec).alias("vec"))
        .agg(F.min(key).alias("vid"), F.count(F.lit(1)).alias("copies"))
    )


def first_copies(df: DataFrame, merged: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, vid)``: every row with the first copy of its vector.

    A vector with a large share of the rows is salted; rows are matched by hash and vector.
    """
    rows = df.select(key, F.xxhash64(vec).alias("_h"), F.col(vec).alias("_v"))
    owners = merged.select(F.xxhash64("vec").alias("_h"), F.col("vec").alias("_v"), "vid")
    joined = salted_join(rows, owners, "_h", "inner", hot_keys(rows, "_h"), [key], also=("_v",))
    return joined.select(key, "vid")


def choose_pivots(df: DataFrame, n_rows: int, key: str = "vid", vec: str = "vec") -> np.ndarray:
    """Evenly hashed sample of vectors as cell centres; at most ``MAX_PIVOTS`` rows."""
    wanted = max(1, min(MAX_PIVOTS, n_rows // BLOCK))
    rows = df.orderBy(F.xxhash64(key), key).limit(wanted).select(vec).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def assign_cells(
    df: DataFrame, pivots: np.ndarray, columns: str, radius: str | float, lower_only: bool = False,
    visitors_only: bool = False,
) -> DataFrame:
    """Rows with their cells: ``(cell, home, <columns>)``, one row per visited cell.

    ``columns`` is the DDL of the columns to carry and includes ``vec``. ``radius`` is the
    search radius, a number or a column. ``lower_only`` restricts visits to cells numbered
    below the home cell, for symmetric searches.
    """
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    between = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), _VISITS):
                yield from assigned(batch.iloc[begin:begin + _VISITS])

    def assigned(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
        squared = np.maximum(
            (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T, 0.0
        )
        home = squared.argmin(1)
        reach = batch["_radius"].to_numpy(dtype=np.float64)[:, None]
        gap = squared - squared[np.arange(len(x)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            to_plane = gap / (2 * between[home])
        near = ~(to_plane > reach + _SLACK)
        cells = np.arange(len(pivots))[None, :]
        at_home = cells == home[:, None]
        if lower_only:
            near &= cells < home[:, None]
        near = (near & ~at_home) if visitors_only else (near | at_home)
        rows, cell = np.nonzero(near)
        # A row can visit every cell, so what it becomes leaves in pieces.
        for begin in range(0, len(rows), _SENT):
            part = slice(begin, begin + _SENT)
            out = batch.iloc[rows[part]][names].reset_index(drop=True)
            out.insert(0, "home", home[rows[part]].astype(np.int32))
            out.insert(0, "cell", cell[part].astype(np.int32))
            yield out

    reach = F.lit(float(radius)) if isinstance(radius, (int, float)) else F.col(radius).cast("double")
    return df.select(*names, reach.alias("_radius")).mapInPandas(visit, f"cell int, home int, {columns}")


def _chunk_counts(df: DataFrame) -> dict[int, int]:
    """Number of chunks per cell; one entry per pivot at most."""
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    least = math.ceil(SPREAD / math.sqrt(max(1, len(rows))))
    return {r["cell"]: max(1, math.ceil(r["n"] / BLOCK), min(least, math.ceil(r["n"] / CHUNK))) for r in rows}


def _with_chunks(df: DataFrame, own: dict[int, int], other: dict[int, int], own_name: str, other_name: str) -> DataFrame:
    """Own chunk by hash, and one copy of the row for every chunk of the other side."""
    def per_cell(counts: dict[int, int]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(0))

    count = per_cell(own)
    others = per_cell(other)
    return (
        df.withColumn("_others", others).filter("_others > 0")
        .withColumn(own_name, F.pmod(F.xxhash64("part" if "part" in df.columns else "vid"), count).cast("int"))
        .withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col("_others") - 1)))
        .drop("_others")
    )


def compare_blocks(
    homes: DataFrame, probes: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]],
    schema: str, diagonal: bool = False, fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None, symmetric: bool = False,
    together: str | None = None,
) -> DataFrame:
    """Apply ``compare(home tile, probe tile)`` to every pair of tiles of each cell.

    Both inputs come from :func:`assign_cells` and have the same columns. A task holds two chunks and what two tiles make of each other.
    ``fold`` reduces the rows that a probe tile has from several home tiles. ``diagonal`` looks
    at a chunk and itself only, a cheap first pass. ``symmetric``: probes are the homes, and a pair of tiles comes once.
    Rows with the same ``part``, where there is that column, share a chunk; home rows with the same value of
    ``together`` share a tile if they are at most ``CHUNK``.
    """
    home_counts, probe_counts = _chunk_counts(homes), _chunk_counts(probes)
    if not home_counts or not probe_counts:
        return homes.sparkSession.createDataFrame([], schema)
    if diagonal:
        left = _with_chunks(homes, home_counts, {c: 1 for c in home_counts}, "_h", "_p").withColumn("_p", F.col("_h"))
        right = _with_chunks(probes, home_counts, {c: 1 for c in home_counts}, "_p", "_h").withColumn("_h", F.col("_p"))
    else:
        left = _with_chunks(homes, home_counts, probe_counts, "_h", "_p")
        right = _with_chunks(probes, probe_counts, home_counts, "_p", "_h")
    sides = left.withColumn("_probe", F.lit(False)).unionByName(right.withColumn("_probe", F.lit(True)))
    if symmetric:
        sides = sides.filter("_h <= _p")

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: tuple[list, list] = ([], [])
        for batch in batches:
            probing = batch["_probe"].to_numpy(dtype=bool)
            for side, own in zip(parts, (~probing, probing)):
                side.append(batch[own])
        # In one order, so that a chunk has the same tiles on both sides.
        home, probe = (pd.concat(side).sort_values([together, "vid"] if together else "vid", ignore_index=True) for side in parts)
        if not len(home) or not len(probe):
            return
        once = symmetric and home["_h"].iloc[0] == home["_p"].iloc[0]
        cuts = _tile_ends(home[together].to_numpy()) if together else [*range(0, len(home), CHUNK), len(home)]
        for j in range(0, len(probe), CHUNK):
            held = None
            for i, end in zip(cuts, cuts[1:]):
                if once and i > j:
                    break
                found = compare(home.iloc[i:end], probe.iloc[j:j + CHUNK])
                for out in [found] if isinstance(found, pd.DataFrame) else found:
                    if not len(out):
                        continue
                    if fold is None:
                        yield out
                    else:
                        held = fold(out if held is None else pd.concat([held, out]))
            if held is not None:
                yield held

    return sides.groupBy("cell", "_h", "_p").applyInPandas(tiles, schema)


def _tile_ends(values: np.ndarray) -> list[int]:
    """Where tiles of sorted rows begin, and the end: no stretch of equal values of at most ``CHUNK`` rows is cut."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    cuts = [0]
    for i, j in zip(begins, [*begins[1:], len(values)]):
        if j - cuts[-1] > CHUNK and i > cuts[-1]:
            cuts.append(i)
        while j - cuts[-1] > CHUNK:
            cuts.append(cuts[-1] + CHUNK)
    return cuts if cuts[-1] == len(values) else [*cuts, len(values)]


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_numpy()).astype(np.float64)
