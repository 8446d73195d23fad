"""All rows against all rows as streams: nearest rows, and the lightest way out of groups of rows.

A task holds a chunk of rows that ask (probes) and reads a segment of the others (homes) batch by batch, so its memory depends on
neither's number. Every row goes to as many tasks as the other side has parts, about the root of the number of tasks.

Distances are told in two steps: a product in single precision gives a lower bound of the squared distance, with the rounding error of the
product taken off; only pairs whose bound is within what is asked are computed, from differences, in double precision. So results are exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.session import cut_lineage

PROBES = 65536  # rows that a task holds
PAIRS = 1_000_000_000  # pairs of a task, about
_LEAST = 8_000_000  # pairs of a task where rows are few
_TASKS = 32  # tasks that few rows are cut into at most
_TILE, _WIDE = 512, 1024  # rows of both sides that meet at once
_MANY = 16  # a tile of which more than this part is left is told in double precision
_GATHER = 1 << 15  # pairs whose differences are held at once
CELLS = 512

Columns = dict[str, np.ndarray]


def _grid(homes: int, probes: int) -> tuple[int, int]:
    """Chunks of probes and segments of homes."""
    tasks = max(math.ceil(homes * probes / PAIRS), min(_TASKS, math.ceil(homes * probes / _LEAST)))
    # Twice as many chunks as segments, as each segment's nearest rows are found from the start.
    chunks = max(math.ceil(probes / PROBES), min(tasks, round(math.sqrt(2 * tasks * probes / homes))))
    return chunks, math.ceil(tasks / chunks)


def cells_of(label: Column | str) -> Column:
    """A bounded number of cells, rows with the same label in the same one."""
    return F.pmod(F.xxhash64(label), F.lit(CELLS)).cast("int")


def meet(homes: DataFrame, probes: DataFrame, work: Callable[[Columns, Iterator[Columns]], Iterator[pa.RecordBatch]], schema: str, order: str = "vid") -> DataFrame:
    """``work(probes, batches of homes)`` for every chunk of probes and segment of homes in each ``cell``.

    Both sides have ``cell``, ``vid``, ``vec`` and the same further columns; lists become matrices. Rows come by ``order``.
    """
    n_homes, n_probes = ({r["cell"]: r["n"] for r in side.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()} for side in (homes, probes))
    grids = {c: _grid(n_homes[c], n) for c, n in n_probes.items() if c in n_homes}  # at most CELLS
    if not grids:
        return homes.sparkSession.createDataFrame([], schema)
    begins = dict(zip(grids, itertools.accumulate([p * s for p, s in grids.values()], initial=0)))
    groups = sum(p * s for p, s in grids.values())

    def told(values: dict[int, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cell"))

    def placed(side: DataFrame, home: bool) -> DataFrame:
        rows = side.withColumns({"_chunks": told({c: p for c, (p, _) in grids.items()}), "_segments": told({c: s for c, (_, s) in grids.items()}), "_begin": told(begins)}).filter("_chunks is not null")
        own = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("_segments" if home else "_chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_chunks" if home else "_segments") - 1))
        rows = rows.withColumn("_own", own).withColumn("_other", other)
        chunk, segment = ("_other", "_own") if home else ("_own", "_other")
        return rows.withColumn("_group", F.col("_begin") + F.col(chunk) * F.col("_segments") + F.col(segment)).withColumn("_home", F.lit(home)).select("_group", "_home", *side.columns)

    def columns(batch: pa.RecordBatch) -> Columns:
        out = {}
        for name, values in zip(batch.schema.names, batch.columns):
            if pa.types.is_list(values.type):
                out[name] = values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            else:
                out[name] = values.to_numpy(zero_copy_only=False)
        return out

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, Columns]]:
        for batch in batches:
            if not len(batch):
                continue
            group, home = batch["_group"].to_numpy(), batch["_home"].to_numpy(zero_copy_only=False)
            key = group.astype(np.int64) * 2 + home
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                yield int(group[i]), bool(home[i]), columns(batch.slice(i, j - i))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(pieces(batches), key=lambda piece: piece[0]):
            held = []
            for _, home, found in rows:
                if home:
                    if held:
                        whole = {name: np.concatenate([x[name] for x in held]) for name in found}
                        yield from work(whole, itertools.chain([found], (x for _, _, x in rows)))
                    break
                held.append(found)

    sides = placed(probes, False).unionByName(placed(homes, True))
    # Probes come first. More partitions than groups, so that few groups share one.
    dealt = sides.repartition(2 * groups, "_group").sortWithinPartitions("_group", "_home", order)
    return dealt.mapInArrow(tasks, schema)


class _Side:
    """Rows of one side, moved by ``centre``, and the factors of lower bounds of squared distances in both precisions."""

    def __init__(self, vec: np.ndarray, centre: np.ndarray, home: bool) -> None:
        self.vec, self.home = vec, home
        self.moved = vec - centre
        self.norms = (self.moved * self.moved).sum(axis=1)
        self.factors: dict[type, np.ndarray] = {}

    def factor(self, kind: type) -> np.ndarray:
        if kind not in self.factors:
            own, one = self.norms * (1 - _error(kind, self.vec.shape[1])), np.ones(len(self.vec))
            parts = [self.moved, one[:, None], own[:, None]] if self.home else [-2 * self.moved, own[:, None], one[:, None]]
            both = np.concatenate(parts, axis=1).astype(kind)
            self.factors[kind] = np.ascontiguousarray(both.T) if self.home else both
        return self.factors[kind]


def _error(kind: type, dims: int) -> float:
    """Rounding error of a product of that many numbers, as a part of both squared norms."""
    return 4 * (dims + 16) * float(np.finfo(kind).eps)


def _precisions(probe: _Side, home: _Side) -> list[type]:
    """Single precision only where squares stay far inside of its range."""
    norms = np.concatenate([probe.norms, home.norms])
    return [np.float32, np.float64] if norms.max() < 1e30 and (norms[norms > 0] > 1e-24).all() else [np.float64]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, from differences: the same number from both sides."""
    out = np.empty(len(x))
    for i in range(0, len(x), _GATHER):
        gap = x[i:i + _GATHER] - y[i:i + _GATHER]
        out[i:i + _GATHER] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _pairs_of(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for i in range(0, len(r), _GATHER):
        out[i:i + _GATHER] = distance(x[r[i:i + _GATHER]], y[c[i:i + _GATHER]])
    return out


def nearest_lists(rows: DataFrame, k: int, label: str | None = None) -> DataFrame:
    """``(vid, near array<struct<dist,other>>)``: the ``k`` nearest other vectors, nearest first; all where there are fewer.

    With ``label`` only rows of the same label are others.
    """
    side = rows.select((cells_of(label) if label else F.lit(0)).alias("cell"), "vid", "vec", (F.xxhash64(label) if label else F.lit(0).cast("long")).alias("label"))
    side = cut_lineage(side)
    schema = pa.schema([("vid", pa.int64()), ("near", pa.list_(pa.struct([("dist", pa.float64()), ("other", pa.int64())])))])

    def work(probe: Columns, homes: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
        n, centre = len(probe["vid"]), probe["vec"].mean(axis=0)
        asks = _Side(probe["vec"], centre, False)
        tiles = [_cut(asks, i, i + _TILE) for i in range(0, n, _TILE)]
        dist, other = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        waiting: list[list] = [[] for _ in tiles]

        def take(i: int) -> None:
            span = slice(i * _TILE, (i + 1) * _TILE)
            _merge(dist[span], other[span], *(np.concatenate(x) for x in zip(*waiting[i])))
            waiting[i] = []

        for home in homes:
            for j in range(0, len(home["vid"]), _WIDE):
                part = slice(j, j + _WIDE)
                gives, ids, names = _Side(home["vec"][part], centre, True), home["vid"][part], home["label"][part]
                for i, tile in enumerate(tiles):
                    span = slice(i * _TILE, (i + 1) * _TILE)
                    alike = None
                    if label:
                        alike = probe["label"][span][:, None] == names[None, :]
                        if not alike.any():
                            continue
                    r, c = _within(tile, gives, np.square(dist[span, -1]), k, alike)
                    keep = probe["vid"][span][r] != ids[c]
                    if alike is not None:
                        keep &= alike[r, c]
                    r, c = r[keep], c[keep]
                    if len(r):
                        waiting[i].append((r, _pairs_of(tile.vec, gives.vec, r, c), ids[c]))
                        if sum(len(x[0]) for x in waiting[i]) * 2 > dist[span].size:
                            take(i)
        for i in range(len(tiles)):
            if waiting[i]:
                take(i)
        for i in range(0, n, 4096):
            d, o = dist[i:i + 4096], other[i:i + 4096]
            got = np.isfinite(d)
            flat = pa.StructArray.from_arrays([pa.array(d[got]), pa.array(o[got])], ["dist", "other"])
            ends = pa.array(np.append(0, np.cumsum(got.sum(axis=1))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(probe["vid"][i:i + 4096]), pa.ListArray.from_arrays(ends, flat)], schema=schema)

    found = meet(side, side, work, "vid long, near array<struct<dist:double,other:long>>", "label")
    # A list from every segment.
    merged = found.groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return cut_lineage(merged)


def _cut(side: _Side, i: int, j: int) -> _Side:
    out = object.__new__(_Side)
    out.vec, out.moved, out.norms, out.home, out.factors = side.vec[i:j], side.moved[i:j], side.norms[i:j], side.home, {}
    return out


def _within(probe: _Side, home: _Side, bound: np.ndarray, k: int, alike: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs whose squared distance may be at most ``bound``, where that is infinite the ``k`` nearest besides the row itself and maybe more."""
    open_rows = np.flatnonzero(np.isinf(bound))
    for kind in _precisions(probe, home):
        low = probe.factor(kind) @ home.factor(kind)
        if alike is not None:
            low[~alike] = np.inf
        most = bound
        if len(open_rows) and low.shape[1] > k + 1:
            kth = np.partition(low[open_rows], k, axis=1)[:, k].astype(float)
            most = bound.copy()
            most[open_rows] = kth + 3 * _error(kind, probe.vec.shape[1]) * (probe.norms[open_rows] + home.norms.max())
        # Rounded up, as the comparison is in that precision.
        most = np.nextafter((most * (1 + 1e-12)).astype(kind), kind(np.inf))
        at = np.flatnonzero(low <= most[:, None])
        if len(at) * _MANY <= low.size:
            break
    return at // low.shape[1], at % low.shape[1]


def _merge(dist: np.ndarray, other: np.ndarray, r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Takes the pairs into the rows' sorted lists."""
    k = dist.shape[1]
    touched = np.unique(r)
    rows = np.concatenate([np.repeat(touched, k), r])
    d, ids = np.concatenate([dist[touched].ravel(), d]), np.concatenate([other[touched].ravel(), ids])
    order = np.lexsort((ids, d, rows))
    rows, d, ids = rows[order], d[order], ids[order]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    first = place < k
    dist[touched], other[touched] = d[first].reshape(-1, k), ids[first].reshape(-1, k)


NONE = -(1 << 62)  # group of a row that is in none
WAYS = "run int, grp long, w double, a long, b long"


def lightest_ways(homes: DataFrame, probes: DataFrame, decimals: int) -> DataFrame:
    """``(run, grp, w, a, b)``: per run and group the lightest pair from a probe in it to a home of another group, if lighter than the bound.

    Both sides have ``cell``, ``vid``, ``vec``, ``label`` (pairs share it) and arrays with an entry per run: ``cores``, ``groups`` (``NONE`` for none)
    and ``bounds`` (below 0: the probe does not ask). A pair weighs as much as its distance and both cores at least.
    """
    schema = pa.schema([("run", pa.int32()), ("grp", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])

    def work(probe: Columns, homes: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
        n, runs = probe["groups"].shape
        centre = probe["vec"].mean(axis=0)
        asks = _Side(probe["vec"], centre, False)
        tiles = [_cut(asks, i, i + _TILE) for i in range(0, n, _TILE)]
        names, codes, best, ends = [], np.empty((n, runs), np.int64), [], []
        for run in range(runs):
            found, codes[:, run] = np.unique(probe["groups"][:, run], return_inverse=True)
            names.append(found)
            best.append(np.full(len(found), -1.0))
            np.maximum.at(best[run], codes[:, run], probe["bounds"][:, run])
            ends.append(np.full((len(found), 2), -1, np.int64))
        asking = probe["bounds"] >= 0
        gap = 10.0 ** -decimals
        for home in homes:
            for j in range(0, len(home["vid"]), _WIDE):
                part = slice(j, j + _WIDE)
                gives, ids = _Side(home["vec"][part], centre, True), home["vid"][part]
                groups, cores, labels = home["groups"][part], home["cores"][part], home["label"][part]

                def settle(run: int, at: int, r: np.ndarray, c: np.ndarray, d: np.ndarray, limit: np.ndarray) -> None:
                    """Takes the pairs that are lighter than the limits and all before."""
                    w = np.maximum(np.maximum(d, probe["cores"][at + r, run]), cores[c, run])
                    which = codes[at + r, run]
                    ok = np.flatnonzero((w < limit) & (w < best[run][which]))
                    order = ok[np.lexsort((ids[c[ok]], probe["vid"][at + r[ok]], w[ok]))]
                    which, first = np.unique(which[order], return_index=True)
                    won = order[first]
                    best[run][which] = w[won]
                    ends[run][which] = np.stack([probe["vid"][at + r[won]], ids[c[won]]], axis=1)

                for at, tile in zip(range(0, n, _TILE), tiles):
                    span = slice(at, at + _TILE)
                    now = np.stack([best[run][codes[span, run]] for run in range(runs)], axis=1)
                    now[~asking[span] | (probe["cores"][span] >= now)] = -np.inf
                    if not (now > 0).any():
                        continue
                    mine, own = probe["groups"][span], probe["label"][span]
                    if runs == 1 and len(groups) and (groups == groups[0]).all() and (mine == groups[0]).all():
                        continue
                    if own[0] != labels[0] and (own == own[0]).all() and (labels == labels[0]).all():
                        continue
                    for run in np.flatnonzero(np.isinf(now).any(axis=0) & (now > 0).any(axis=0)).tolist():
                        # Where nothing is known yet, the closest row of another group is a first way out.
                        rows = np.flatnonzero(now[:, run] == np.inf)
                        if not len(rows):
                            continue
                        low = tile.factor(np.float64)[rows] @ gives.factor(np.float64)
                        low[(mine[rows, run][:, None] == groups[:, run][None, :]) | (groups[:, run] == NONE)[None, :] | (own[rows][:, None] != labels[None, :])] = np.inf
                        c = low.argmin(axis=1)
                        there = np.isfinite(low[np.arange(len(rows)), c])
                        now[rows[~there], run] = -np.inf
                        rows, c = rows[there], c[there]
                        settle(run, at, rows, c, np.round(_pairs_of(tile.vec, gives.vec, rows, c), decimals), np.full(len(rows), np.inf))
                        now[rows, run] = best[run][codes[span, run][rows]]
                    r, c = _ways(tile, gives, now, mine, groups, own, labels, gap)
                    if not len(r):
                        continue
                    d = np.round(_pairs_of(tile.vec, gives.vec, r, c), decimals)
                    for run in range(runs):
                        ok = (mine[r, run] != groups[c, run]) & (groups[c, run] != NONE) & (own[r] == labels[c])
                        settle(run, at, r[ok], c[ok], d[ok], now[r[ok], run])
        for run in range(runs):
            got = ends[run][:, 1] != -1
            if got.any():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(got.sum(), run, np.int32)), pa.array(names[run][got]), pa.array(best[run][got]),
                    pa.array(ends[run][got, 0]), pa.array(ends[run][got, 1])], schema=schema)

    told = meet(homes, probes, work, WAYS, "order")
    return told.groupBy("run", "grp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("run", "grp", "e.*")


def _ways(probe: _Side, home: _Side, now: np.ndarray, mine: np.ndarray, groups: np.ndarray, own: np.ndarray, labels: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may be lighter than ``now`` in a run in which their groups differ."""
    most = np.square(np.maximum(now, 0) + gap) * (1 + 1e-12)
    most[now < 0] = -1.0
    for kind in _precisions(probe, home):
        low = probe.factor(kind) @ home.factor(kind)
        upper = np.nextafter(most.astype(kind), kind(np.inf))
        upper[most < 0] = -np.inf
        at = np.flatnonzero(low <= upper.max(axis=1)[:, None])
        if len(at) * 4 * _MANY > low.size:
            # Many pairs are close: those of the same group go first.
            apart = np.zeros(low.shape, bool)
            for run in range(now.shape[1]):
                if (now[:, run] >= 0).any():
                    apart |= (low <= upper[:, run][:, None]) & (mine[:, run][:, None] != groups[:, run][None, :])
            apart &= own[:, None] == labels[None, :]
            at = np.flatnonzero(apart)
        if len(at) * _MANY <= low.size:
            break
    return at // low.shape[1], at % low.shape[1]
