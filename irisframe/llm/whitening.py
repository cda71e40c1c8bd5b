"""Whitening components of an embedding table by shifted CholeskyQR.

The centred rows A of the table are never gathered. A pass over them sums the Gram
matrix, whose Cholesky factor R makes the rows Q = A R^-1 nearly orthogonal; further
passes orthogonalise those again, each time by triangular solves inside the tasks.
The first factor is taken of the Gram matrix plus a small shift, so that it exists
for any condition number. The product of the factors is the R of A = QR, and the
singular values and right vectors of R are those of A.

The driver holds the sums, the factors and Gram matrices of the dimension squared,
never a row. Sums are exact; nothing depends on the order of the tasks but the last
bits of the Gram matrices, and the components are computed once for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Passes after the shifted one, at most; two are enough unless A lacks full rank.
PASSES = 4
_UNIT = np.finfo(np.float64).eps / 2
#: Values of more than so many bits do not occur: such vectors count as unusable.
_LARGEST = 1 << 52
_BLOCK = 4096


def scaled(vector: Column) -> Column:
    """floor(SCALE * c) of each entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether all entries are numbers that can be scaled."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(_LARGEST / SCALE), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part.

    A vector that is null, empty or holds a null, NaN, infinite entry or one beyond
    2**52 / SCALE drops out; so do vectors of another length than the most frequent
    one (of equally frequent lengths the longest). Repeated rows stay.
    """
    kept = rows.filter(usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col(vector)).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return np.asarray(column.flatten(), dtype=np.int64).reshape(batch.num_rows, -1)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


@dataclass(frozen=True)
class Totals:
    """Number of rows of the fit list and the exact sum of each dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def totals(fit: DataFrame) -> Totals:
    """Sums as decimals, so that they are exact at any size."""
    n = fit.count()
    exact = F.sum(F.col("v").cast("decimal(38,0)"))
    rows = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(exact.alias("s")).orderBy("i").collect()
    return Totals(n, tuple(int(r["s"]) for r in rows))


def _gram_rows(fit: DataFrame, make, width: int) -> np.ndarray:
    """Sum over the fit list of the Gram matrix of ``make(x)``, a width-column matrix.

    A task gives one row for each entry of the upper triangle, and these are summed
    by a shuffle, so the driver gets the entries once and not once for each task.
    """
    at = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                rows = make(_matrix(batch.slice(start, _BLOCK)))
                total += rows.T @ rows
        yield pa.record_batch({"entry": pa.array(np.arange(len(at[0])), pa.int64()), "value": pa.array(total[at])})

    found = fit.select("x").mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((width, width))
    for r in found:
        i, j = at[0][r["entry"]], at[1][r["entry"]]
        out[i, j] = out[j, i] = r["value"]
    return out


def orthogonalised(fit: DataFrame, centre: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(factors, Gram matrix of the last rows): A = Q R with R their product, the
    last factor leftmost, and Q nearly orthogonal where A has full rank.

    Dimensions that do not vary, or depend on others, keep the Gram matrix from
    becoming the identity; the remaining passes are then left out after PASSES.
    """
    d, factors = len(centre), []
    gram = _gram_rows(fit, lambda x: x - centre, d)
    share = 11 * (n * d + d * (d + 1)) * _UNIT
    shift = share * max(float(np.trace(gram)), _UNIT)
    for _ in range(PASSES):
        factors.append(np.linalg.cholesky(gram + shift * np.eye(d)).T)
        chain = list(factors)

        def rows(x: np.ndarray) -> np.ndarray:
            out = x - centre
            for factor in chain:
                out = solved(out, factor)
            return out

        gram = _gram_rows(fit, rows, d)
        if np.abs(gram - np.eye(d)).max() < 1e-14 * max(n, d) ** 0.5 + 1e-13:
            break
        # After the shifted pass no shift is needed, but for lacking rank.
        shift = 0.0 if np.linalg.eigvalsh(gram)[0] > 1e-8 else share * max(float(np.trace(gram)), _UNIT)
    return factors, gram


@dataclass(frozen=True)
class Whitening:
    """Components as rows, by falling variance, of the ``totals.n`` fitted rows."""

    totals: Totals
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.totals.mean) @ self.components.T / np.sqrt(self.variances)


def fit_whitening(fit: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct rows x of ``fit``; None for an empty table.

    Components without variance (all vectors equal, fewer vectors than components)
    cannot be whitened and are left out. The sign of a component makes its largest
    entry positive.
    """
    found = totals(fit)
    if not found.n:
        return None
    factors, gram = orthogonalised(fit, found.mean, found.n)
    r = np.eye(len(found.sums))
    for factor in factors:
        r = factor @ r
    # What is left of Q's Gram matrix: the identity, up to rounding and lacking rank.
    values, turn = np.linalg.eigh(gram)
    _, singular, right = np.linalg.svd((np.sqrt(np.maximum(values, 0))[:, None] * turn.T) @ r)
    variances = singular**2 / found.n
    chosen = [k for k in range(min(count, len(variances))) if variances[k] > 1e-12 * max(variances[0], 1e-300) and variances[k] > 1e-9]
    sign = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])
    return Whitening(found, (right * sign[:, None])[chosen], variances[chosen], float(variances.sum()))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity."""
    k = len(model.variances)
    moments = _gram_rows(fit, lambda x: np.column_stack([model.whiten(x), np.ones(len(x))]), k + 1)
    mean = moments[k, :k] / model.totals.n
    covariance = moments[:k, :k] / model.totals.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def _deviations(x: np.ndarray, found: Totals) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; null where it does not fit a long."""
    sums = np.array(found.sums, dtype=object)
    bound = found.n * int(np.abs(x).max(initial=0)) + max(map(abs, found.sums), default=0)
    if bound * bound * x.shape[1] < 1 << 63:
        away = found.n * x - sums.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    away = found.n * x.astype(object) - sums
    exact = [int(v) for v in (away * away).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row
    for each usable vector and component.

    The fit list is each distinct scaled vector once; every usable row is whitened,
    also repeated ones and those without vec_id. A table without usable vectors, or
    whose vectors are all equal, gives no rows. Only vec_id and the vector are read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = stored(vectors(rows, vector), "whitening-rows")
    fit = stored(kept.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, count)
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    error, share = identity_error(fit, model), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                x = _matrix(part)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch(
                    {
                        "vec_id": part.column("vec_id").take(pa.array(each)),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(each), model.totals.n, dtype=np.int64)),
                        "deviation": pa.array(_deviations(x, model.totals), pa.int64()).take(pa.array(each)),
                        "whitened": pa.array(model.whiten(x).ravel()),
                        "explained": pa.array(np.tile(share, len(x))),
                        "identity_error": pa.array(np.full(len(each), error)),
                    }
                )

    return kept.mapInArrow(run, schema)
