"""Whitening by CholeskyQR against numpy's eigenvectors."""

import math

import numpy as np
import pytest

from irisframe.llm import queries, whitening

from .test_payloads import FOLDER


def check(found, rows):
    """``rows``: (vec_id, usable vector)."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: min(4, x.shape[1])]
    assert len(found) == len(rows) * len(order)
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for k, at in enumerate(order):
        expected = (x - sums / n) @ turned[:, at] / np.sqrt(values[at])
        got = np.array([by[i, int(((n * row - sums) ** 2).sum())][k + 1].whitened for (i, _), row in zip(rows, x)])
        flip = np.sign((got * expected).sum())
        assert np.abs(flip * got - expected).max() < 1e-9
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[order[r.component - 1]] / values.sum()) < 1e-9


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(queries.op13_embedding_whitening(spark, FOLDER).collect(), rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, x string, n string")


def test_unusable_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    scale = np.array([9.0, 3.0, 1.0, 0.1, 5.0])
    good = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(60, 5)) * scale)]
    good += [(7, good[3][1])] * 30 + [(None, good[4][1]), (90, [-0.0] * 5)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 1.0, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    check(whitening.whitened(frame(spark, bad + good).repartition(4)).collect(), good)


@pytest.mark.parametrize("d", [1, 2, 6])
def test_dimensions_that_depend_on_others(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(v) for v in rng.integers(-9, 9, d)]) for i in range(40)]
    doubled = [(i, [*v, *[2.0] * 2, v[0]]) for i, v in rows]
    found = whitening.whitened(frame(spark, doubled)).collect()
    assert {r.component for r in found} == set(range(1, min(4, d) + 1)) and found[0].identity_error < 1e-9
    first = sorted((r.vec_id, r.whitened) for r in found if r.component == 1)
    x = np.array([v for _, v in doubled]) * 256
    fit = np.unique(x, axis=0)
    values, turned = np.linalg.eigh(np.cov(fit.T, bias=True))
    expected = (x - fit.mean(axis=0)) @ turned[:, -1] / np.sqrt(values[-1])
    got = np.array([w for _, w in first])
    assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-9


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whitened(frame(spark, rows)).collect() == []


def test_exact_deviations():
    found = whitening.Totals(10**7, (5, -(10**12)))
    x = np.array([[3, -7], [10**11, 0]])
    assert whitening._deviations(x[:1], found) == [(3 * 10**7 - 5) ** 2 + (10**12 - 7 * 10**7) ** 2 if (10**12) ** 2 < 1 << 63 else None]
    assert whitening._deviations(x, whitening.Totals(2, (1, 1))) == [(6 - 1) ** 2 + 15**2, None]


def test_triangular_solve_and_bad_condition(spark):
    rng = np.random.default_rng(1)
    factor = np.triu(rng.normal(size=(5, 5))) + 5 * np.eye(5)
    rows = rng.normal(size=(9, 5))
    assert np.abs(whitening.solved(rows, factor) @ factor - rows).max() < 1e-12
    x = (rng.normal(size=(500, 4)) * [2**30, 2**20, 2**10, 2**4]).astype(np.int64)
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>")
    model = whitening.fit_whitening(fit)
    exact = np.linalg.eigvalsh(np.cov(x.T.astype(float), bias=True))[::-1]
    assert np.abs(model.variances / exact[: len(model.variances)] - 1).max() < 1e-6 and whitening.identity_error(fit, model) < 1e-6
