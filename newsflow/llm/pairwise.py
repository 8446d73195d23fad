"""Bradley-Terry scores of documents, learned from preference pairs.

A document's strength is a weighted sum of its features; the chance that one is preferred to
another is the logistic function of the difference. Pairs are good and poor labelled documents;
the loss is the logistic loss on feature differences. The strength at the quantile that
separates the share of poor documents is the threshold, where the reported score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsflow.llm.labelled import HELD_OUT, fold, labelled_texts
from newsflow.llm.text_stats import SHAPES, basic, scan, shapes
from newsflow.llm.words import Words

#: Labelled documents that the weights are learned from, at most.
FIT_ROWS = 12_000
#: Preference pairs for each document of the rarer label.
PAIRS = 16

# Kinds of bytes whose runs of three describe how a text looks, in any language.
_KINDS = np.full(256, 7, np.uint8)
for _kind, _bytes in enumerate((b" \t\v\f\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"#*$%&|<>!=_~^@/\\+[]{}`")):
    _KINDS[list(_bytes)] = _kind
SIZE = len(SHAPES) + 512


def features(words: Words, prints: np.ndarray) -> np.ndarray:
    """Statistics of each text and the square roots of its shares of byte-kind triples."""
    n, rows = len(words.rows) - 1, words.rows
    kinds = _KINDS[words.data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(rows))
    if len(kinds) > 2:
        triple = kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:]
        same = row[2:] == row[:-2]
        shares = np.bincount((row[2:] * 512 + triple)[same], minlength=n * 512).reshape(n, 512).astype(float)
    else:
        shares = np.zeros((n, 512))
    shares = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    return np.hstack([shapes(words, prints, basic(words, prints)), shares]).astype(np.float32)


@dataclass
class Strengths:
    mean: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.scale, -30, 30)))


def fit_strengths(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 300, ridge: float = 1e-3) -> Strengths:
    """Weights by accelerated gradient descent on the pairs' loss, threshold at the quantile of the poor share.

    With no rows or one label there is no preference: every score is 0.5 or better.
    """
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Strengths(np.zeros(SIZE), np.zeros(SIZE), 0.0 if len(good) or not len(poor) else 1.0, 1.0)
    mean, spread = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)
    unit = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    z = ((x - mean) * unit).clip(-6, 6).astype(np.float32)
    draw = np.random.Generator(np.random.PCG64(7))
    count = pairs * min(len(good), len(poor))
    a, b = draw.choice(good, count), draw.choice(poor, count)
    # The largest curvature of the loss bounds the step.
    curve = max(float(np.square(z[a[:4096]] - z[b[:4096]]).sum(axis=1).mean()) / 4, 1.0) + ridge
    w, before, last = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    for _ in range(steps):
        now = (1 + np.sqrt(1 + 4 * last**2)) / 2
        v = w + (last - 1) / now * (w - before)
        s = z @ v.astype(np.float32)
        lost = 1 / (1 + np.exp(np.clip(s[a] - s[b], -50, 50))) / count
        per_row = np.bincount(a, lost, len(y)) - np.bincount(b, lost, len(y))
        before, w, last = w, v + (z.T @ per_row.astype(np.float32) - ridge * v) / curve, now
    weights = w * unit
    strength = (x - mean) @ weights
    ordered = np.sort(strength)
    at = len(poor)
    return Strengths(mean, weights, float(ordered[at - 1] + ordered[min(at, len(ordered) - 1)]) / 2, 1.0)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words, prints in scan(batches):
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(words, prints)], pa.binary()), batch.column("label")], ["x", "label"])


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Strengths:
    """Strengths for ``labels.quality`` from at most ``limit`` labelled documents of the learning folds."""
    rows = labelled_texts(docs, labels, limit).mapInArrow(_sample, "x binary, label int").toArrow()
    x, y = rows["x"].to_pylist(), rows["label"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (x[i], y[i]))
    return fit_strengths(np.frombuffer(b"".join(x[i] for i in order), np.float32).reshape(-1, SIZE), np.array([y[i] for i in order]))


def quality_scores(docs: DataFrame, model: Strengths, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every document; null and empty texts are scored as empty.

    One row per input row, whatever the key holds; a null key is held out of nothing.
    Only ``text`` decides the score. Each row is scored alone: no shuffle.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, prints in scan(batches):
            score = model.score(features(words, prints))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["key", "score", "predicted"])

    schema = StructType([StructField("key", docs.schema[key].dataType), *StructType.fromDDL("score double, predicted int").fields])
    scored = docs.select(F.col(key).alias("key"), "text").mapInArrow(judge, schema)
    return scored.select(F.col("key").alias(key), F.coalesce(fold("key") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
