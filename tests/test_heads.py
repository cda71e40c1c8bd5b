"""Heads are judged on separable rows; the sample vectors carry no signal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irisframe.operators import confusion, fold_heads, heads, splits
from irisframe.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(240):
        k = i % 3
        vec = [rng.gauss(3.0 if j == k else 0.0, 0.4) for j in range(4)]
        data.append((i, k, vec, [rng.gauss(0, 1) for _ in range(4)]))
    return spark.createDataFrame(data, "id long, label int, v array<double>, w array<double>").cache()


def accuracy(df):
    return confusion.accuracy(df).first().accuracy


def test_linear_head(rows):
    scored = heads.score_head(heads.fit_linear_head(rows, "v"), rows, "v")
    assert accuracy(scored) == 1.0
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in scored.collect())
    assert accuracy(heads.score_head(heads.fit_linear_head(rows, "w"), rows, "w")) < 0.7


def test_fusion_head(rows):
    model = heads.fit_fusion_head(rows, "w", "v", 4, 3, hidden=16, iterations=60)
    scored = heads.score_fusion_head(model, rows, "w", "v")
    assert accuracy(scored) > 0.97 and scored.count() == 240


def test_cross_validation_scores_every_row_once(rows):
    folded = splits.stratified_folds(rows, "label", "id")
    preds = heads.cross_validated(folded, "v", 5, iterations=10)
    assert preds.select("id").distinct().count() == preds.count() == 240
    assert accuracy(preds) > 0.97
    assert preds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] == 48


def test_folds_fitted_together_equal_separate_fits(spark, rows):
    # Overlapping classes on unequal scales: the optimum is finite and not trivial.
    wide = rows.withColumn("x", F.transform("w", lambda v, i: v * (i + 1) * 3 + F.col("label") * 2 + 50 * i))
    folded = splits.stratified_folds(wide, "label", "id").select("id", "fold", "label", "x").cache()
    together = fold_heads.fit_fold_heads(folded, "x", 5, weight_decay=0.01, iterations=200)
    for k in range(5):
        train, _ = splits.fold_parts(folded, k)
        alone = heads.LogisticRegression(maxIter=500, tol=1e-13, regParam=0.01, elasticNetParam=0.0, family="multinomial")
        model = alone.fit(heads.with_features(train, "x").select("features", "label"))
        assert np.allclose(together.coefficients[k], model.coefficientMatrix.toArray(), rtol=0, atol=1e-6)
        assert np.allclose(together.intercepts[k], model.interceptVector.toArray(), atol=1e-5)
    again = fold_heads.fit_fold_heads(folded.repartition(3), "x", 5, weight_decay=0.01, iterations=200)
    assert np.allclose(together.coefficients, again.coefficients, atol=1e-7)


def test_gradient_of_fold_losses(rows):
    folded = rows.withColumn("fold", (F.col("id") % 3).cast("int"))
    train = fold_heads._training(folded, "w", 3, 4)
    rng = np.random.default_rng(1)
    centers, scales, points = rng.normal(size=(3, 4)), rng.uniform(0.5, 2, (3, 4)), rng.normal(size=(3, 3, 5))
    _, slope = fold_heads.fold_losses(train, centers, scales, points)
    step = 1e-5
    for c, j in [(0, 0), (1, 2), (2, 4)]:
        ahead, behind = points.copy(), points.copy()
        ahead[:, c, j] += step
        behind[:, c, j] -= step
        numeric = (fold_heads.fold_losses(train, centers, scales, ahead)[0] - fold_heads.fold_losses(train, centers, scales, behind)[0]) / (2 * step)
        assert np.allclose(numeric, slope[:, c, j], rtol=1e-5, atol=1e-5)


def test_odd_rows_train_nothing_and_get_no_prediction(spark, rows):
    folded = splits.stratified_folds(rows, "label", "id").select("id", "fold", "label", "v")
    odd = [(900, 1, 1, None), (901, 2, 0, [1.0]), (902, 0, 2, [0.0, float("nan"), 0.0, 0.0]), (903, 3, 1, [0.0, None, 0.0, 0.0]), (904, None, None, [9.0] * 4)]
    more = folded.unionByName(spark.createDataFrame(odd, "id long, fold int, label int, v array<double>"))
    plain = {r.id: r.probs for r in heads.cross_validated(folded, "v", 5, iterations=5).collect()}
    got = {r.id: r for r in heads.cross_validated(more, "v", 5, iterations=5).collect()}
    assert set(got) == set(plain) | {900, 901, 902, 903}
    assert all(got[i].probs is None and got[i].pred is None for i in (900, 901, 902, 903))
    assert all(np.allclose(got[i].probs, p) for i, p in plain.items())
    with pytest.raises(ValueError):
        fold_heads.fit_fold_heads(folded.limit(0), "v", 5)


def test_queries_fit_whole_vectors(spark):
    rows = queries._separable(spark, "/root/testdata/sf0.001")
    assert rows.filter((F.size("a") != 64) | (F.size("both") != 74)).isEmpty()
