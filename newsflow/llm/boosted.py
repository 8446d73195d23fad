"""Gradient-boosted trees with monotone features, fitted on a sample and scored from flat arrays.

`fit_trees` makes the trees from binned features. `FlatTrees` keeps all nodes of all trees in a
few numpy arrays; a leaf points to itself, so that scoring is ``depth`` gathers per tree for all
rows at once. A feature with constraint -1 can only lower the score as it grows, +1 only raise it:
the way through a split must be ordered, and both sides are kept on their side of its middle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsflow.llm.labelled import labelled_texts
from newsflow.llm.text_stats import SHAPES, basic, scan, shapes

# What may only speak against a document, or only for it.
MONOTONE = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_per_word": -1, "bar_per_word": -1,
    "twin_share": -1, "control_share": -1, "distinct_share": 1,
}
#: Labelled documents that the trees are fitted on, at most.
FIT_ROWS = 12_000


@dataclass
class FlatTrees:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values, at most ``bins - 1`` of them at quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    least: int = 8, ridge: float = 1.0,
) -> FlatTrees:
    """Logistic loss, second order, histogram splits. With no rows or one class: a constant."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        # With nothing to tell apart nothing is rejected.
        base = 0.0 if not len(y) else 10.0 if share else -10.0
        zero = np.zeros(1, np.int64)
        return FlatTrees(zero, np.zeros(1), zero, zero, np.zeros(1), zero, 1, base)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, at, at, weight * rate])
        if level == depth or len(rows) < 2 * least:
            return at
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            own = binned[rows, j]
            gs = np.cumsum(np.bincount(own, g[rows], len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(own, h[rows], len(e) + 1))[:-1]
            ns = np.cumsum(np.bincount(own, minlength=len(e) + 1))[:-1]
            wl = np.clip(-gs / (hs + ridge), low, high)
            wr = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
            loss = gs * wl + (hs + ridge) * wl**2 / 2 + (total_g - gs) * wr + (total_h - hs + ridge) * wr**2 / 2
            gain = total_g * weight + (total_h + ridge) * weight**2 / 2 - loss
            allowed = (ns >= least) & (len(rows) - ns >= least) & ((wr - wl) * monotone[j] >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k, wl[k], wr[k])
        _, j, k, wl, wr = best
        if j < 0:
            return at
        middle = (wl + wr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[j])]
        side = binned[rows, j] <= k
        nodes[at][:2] = [j, edges[j][k]]
        nodes[at][2] = grow(rows[side], g, h, level + 1, *bounds[0])
        nodes[at][3] = grow(rows[~side], g, h, level + 1, *bounds[1])
        return at

    everyone = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        root = grow(everyone, p - y, p * (1 - p), 0, -4.0, 4.0)
        roots.append(root)
        flat = _flatten(nodes, [root], depth, 0.0)
        margin += flat.margin(x)
    return _flatten(nodes, roots, depth, base)


def _flatten(nodes: list[list], roots: list[int], depth: int, base: float) -> FlatTrees:
    columns = list(zip(*nodes))
    return FlatTrees(
        np.array(columns[0], np.int64), np.array(columns[1], float), np.array(columns[2], np.int64), np.array(columns[3], np.int64),
        np.array(columns[4], float), np.array(roots, np.int64), depth, base,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words, prints in scan(batches):
        x = shapes(words, prints, basic(words, prints))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("label")], ["x", "label"])


def fit_quality_rules(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> FlatTrees:
    """Trees for ``labels.quality`` from at most ``limit`` labelled documents of the learning folds."""
    rows = labelled_texts(docs, labels, limit).mapInArrow(_features, "x binary, label int").toArrow()
    order = sorted(range(len(rows)), key=lambda i: (rows["x"][i].as_py(), rows["label"][i].as_py()))
    x = np.frombuffer(b"".join(rows["x"][i].as_py() for i in order), float).reshape(-1, len(SHAPES))
    y = np.array([rows["label"][i].as_py() for i in order], float)
    return fit_trees(x, y, np.array([MONOTONE.get(name, 0) for name in SHAPES]))


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, verdict boolean, kept boolean"


def quality_rules(docs: DataFrame, trees: FlatTrees, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Counts, base rule and verdict of every document (``key`` and the columns of RULES).

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word
    windows. verdict: the trees' probability of good quality is at least ``threshold``.
    kept: the verdict, unless base_failed. Null and empty texts have no words and fail. One row per input row, whatever
    the key holds; other columns are not read. Each row is judged alone: no shuffle.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, prints in scan(batches):
            counts = basic(words, prints)
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = trees.probability(shapes(words, prints, counts))
            columns = [counts[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [failed, score, score >= threshold, ~failed & (score >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, columns)], ["key", *[c.split()[0] for c in RULES.split(", ")]])

    schema = StructType([StructField("key", docs.schema[key].dataType), *StructType.fromDDL(RULES).fields])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(judge, schema).withColumnRenamed("key", key)
