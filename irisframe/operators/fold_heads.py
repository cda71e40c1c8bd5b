"""Linear heads of all folds fitted together: one scan of the table an iteration.

Every row trains all folds but its own, so a batch of vectors is multiplied once with
the coefficients of all folds side by side, and each fold's gradient leaves out its
own rows. A task adds up its batches and sends one number for each coefficient; Spark
sums these by coefficient, so the driver gets one gradient a fold, whatever the rows.
The steps (L-BFGS) are taken on the driver for all folds in lockstep.

The objective is that of :func:`~irisframe.operators.heads.fit_linear_head`: mean
cross-entropy, and half the weight decay times the squared coefficients of features
scaled to unit deviation in the fold's training rows; intercepts are free and centred.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Correction pairs kept by the optimiser, and the gradient norm that ends it.
HISTORY, TOLERANCE = 10, 1e-9


@dataclass(frozen=True)
class FoldHeads:
    """``coefficients[fold, class, feature]``, ``intercepts[fold, class]`` and each
    fold's number of data passes that still changed it."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: np.ndarray


def _usable(features: str, width: int) -> Column:
    sound = F.forall(F.col("_x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(features).isNotNull() & (F.size("_x") == width) & sound


def _training(folded: DataFrame, features: str, folds: int, width: int) -> DataFrame:
    rows = folded.withColumn("_x", F.col(features).cast("array<double>"))
    kept = _usable(features, width) & F.col("label").isNotNull() & F.col("fold").between(0, folds - 1)
    return rows.filter(kept).select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "_x")


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``add(fold, label, vectors)``, which gives ``size``
    numbers for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                fold, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label"))
                vectors = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
                total += add(fold, label, vectors.reshape(batch.num_rows, -1))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["slot", "v"])

    parts = rows.mapInArrow(run, "slot int, v double")
    # One row for each slot: coefficients, never rows of the table.
    sums = parts.groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[sums["slot"].to_numpy()] = sums["v"].to_numpy()
    return out


def _scales(rows: DataFrame, folds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training rows of each fold, each feature's mean in them, and one over its
    deviation (0 for a constant one). Squares are taken around the mean of all rows."""

    def sums(center: np.ndarray, power: int):
        def add(fold, label, x):
            out = np.zeros((folds, 1 + width))
            np.add.at(out[:, 0], fold, 1.0)
            np.add.at(out[:, 1:], fold, (x - center) ** power)
            return out.ravel()

        return _summed(rows, folds * (1 + width), add).reshape(folds, 1 + width)

    first = sums(np.zeros(width), 1)
    whole = first.sum(axis=0)
    if not whole[0]:
        raise ValueError("no row has a fold, a label and a sound vector")
    center = whole[1:] / whole[0]
    n, shifted = whole[0] - first[:, 0], whole[1:] - first[:, 1:]
    squares = sums(center, 2)[:, 1:]
    squares = squares.sum(axis=0) - squares
    if (n < 1).any():
        raise ValueError("a fold has no training rows")
    apart = shifted / n[:, None] - center
    variance = (squares - n[:, None] * apart**2) / np.maximum(n - 1, 1)[:, None]
    varies = variance > 1e-14 * np.maximum(center**2, 1e-300)
    return n, center + apart, np.where(varies, 1 / np.sqrt(np.where(varies, variance, 1)), 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _plain(centers: np.ndarray, scales: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts for features as they are."""
    weights = points[:, :, 1:] * scales[:, None, :]
    return weights, points[:, :, 0] - (weights * centers[:, None, :]).sum(axis=2)


def fold_losses(
    rows: DataFrame, centers: np.ndarray, scales: np.ndarray, points: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Summed cross-entropy of each fold's training rows and its gradient, in one scan.

    ``points[fold, class, 1 + feature]`` holds the intercept and the coefficients of
    centred and scaled features."""
    folds, classes, wide = points.shape
    plain, free = _plain(centers, scales, points)
    weights, start = plain.reshape(folds * classes, wide - 1), free.reshape(-1)

    def add(fold, label, x):
        n = len(label)
        logits = (x @ weights.T + start).reshape(n, folds, classes)
        top = logits.max(axis=2)
        spread = np.log(np.exp(logits - top[:, :, None]).sum(axis=2)) + top
        trains = fold[:, None] != np.arange(folds)[None, :]
        loss = ((spread - logits[np.arange(n), :, label]) * trains).sum(axis=0)
        off = np.exp(logits - spread[:, :, None])
        off[np.arange(n), :, label] -= 1.0
        off *= trains[:, :, None]
        slopes = (off.reshape(n, folds * classes).T @ x).reshape(folds, classes, wide - 1)
        return np.concatenate([loss, off.sum(axis=0).ravel(), slopes.ravel()])

    sums = _summed(rows, folds * (1 + classes * wide), add)
    loss, rest = sums[:folds], sums[folds:]
    free = rest[: folds * classes].reshape(folds, classes, 1)
    slopes = rest[folds * classes :].reshape(folds, classes, wide - 1)
    slopes = (slopes - free * centers[:, None, :]) * scales[:, None, :]
    return loss, np.concatenate([free, slopes], axis=2)


def _descent(x: np.ndarray, iterations: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a conversation: yields a point, is sent its loss and gradient, and
    returns the last point that lowered the loss."""
    loss, slope = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.linalg.norm(slope) <= TOLERANCE * max(1.0, np.linalg.norm(x)):
            break
        way = -slope
        weights = []
        for s, y in reversed(pairs):
            weights.append(s @ way / (s @ y))
            way = way - weights[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(weights)):
            way = way + s * (a - y @ way / (s @ y))
        step = 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(slope))
        while True:
            there = x + step * way
            new_loss, new_slope = yield there
            # Near the optimum a gain is lost in the rounding of the sums.
            if new_loss <= loss + 1e-4 * step * (slope @ way) + 1e-14 * abs(loss):
                break
            step /= 2
            if step < 1e-10:
                return x
        s, y = there - x, new_slope - slope
        if s @ y > 1e-14 * (y @ y):
            pairs = [*pairs, (s, y)][-HISTORY:]
        x, loss, slope = there, new_loss, new_slope
    return x


def fit_fold_heads(
    folded: DataFrame, features: str, folds: int, *, weight_decay: float = 1e-4, iterations: int = 25
) -> FoldHeads:
    """A linear head for every fold, each fitted on the rows of all other folds.

    Rows without a fold or label, and vectors that are null, of another width than
    the longest, or hold null or non-finite entries, train nothing. The table is read
    once for every point tried, by all folds at once, so it should be stored.
    """
    shape = folded.agg(F.max(F.size(features)).alias("w"), F.max(F.col("label").cast("int")).alias("c")).first()
    if shape["w"] is None or shape["w"] < 1 or shape["c"] is None:
        raise ValueError("no row has a label and a vector")
    width, classes = shape["w"], shape["c"] + 1
    rows = _training(folded, features, folds, width)
    n, centers, scales = _scales(rows, folds, width)
    points = np.zeros((folds, classes, 1 + width))
    talks = {k: _descent(points[k].ravel(), iterations) for k in range(folds)}
    for talk in talks.values():
        next(talk)
    passes = np.zeros(folds, dtype=int)
    while talks:
        loss, slope = fold_losses(rows, centers, scales, points)
        for k, talk in list(talks.items()):
            passes[k] += 1
            decay = weight_decay * points[k]
            decay[:, 0] = 0.0
            value = loss[k] / n[k] + 0.5 * float((decay * points[k]).sum())
            try:
                points[k] = talk.send((value, (slope[k] / n[k] + decay).ravel())).reshape(classes, 1 + width)
            except StopIteration as end:
                points[k] = end.value.reshape(classes, 1 + width)
                del talks[k]
    coefficients, intercepts = _plain(centers, scales, points)
    return FoldHeads(coefficients, intercepts - intercepts.mean(axis=1, keepdims=True), passes)


def score_by_fold(heads: FoldHeads, folded: DataFrame, features: str) -> DataFrame:
    """Add ``probs`` and ``pred`` from the head that has not seen the row's fold. Rows
    without a fold are left out; unusable vectors get null for both."""
    folds, _, width = heads.coefficients.shape
    weights, start = heads.coefficients, heads.intercepts

    @F.pandas_udf("array<double>")
    def probs(x: pd.Series, fold: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        known = x.notna().to_numpy()
        for k in np.unique(fold.to_numpy()[known]):
            at = np.flatnonzero(known & (fold.to_numpy() == k))
            p = _softmax(np.stack(x.to_numpy()[at]) @ weights[k].T + start[k])
            for i, row in zip(at, p):
                out.iat[i] = row
        return out

    rows = folded.filter(F.col("fold").between(0, folds - 1)).withColumn("_x", F.col(features).cast("array<double>"))
    vector = F.when(_usable(features, width), F.col("_x"))
    scored = rows.withColumn("probs", probs(vector, F.col("fold").cast("int")))
    best = F.array_position("probs", F.array_max("probs")) - 1
    return scored.withColumn("pred", best.cast("int")).drop("_x")
