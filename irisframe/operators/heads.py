"""Fitting linear and fusion heads on feature tables with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fuse
from ..session import scratch_dir
from .fold_heads import fit_fold_heads, score_by_fold


def with_features(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))


def fit_linear_head(df: DataFrame, features: str, *, weight_decay: float = 1e-4, iterations: int = 25):
    """A multinomial linear layer on frozen features; the L2 term plays weight decay."""
    head = LogisticRegression(
        maxIter=iterations, regParam=weight_decay, elasticNetParam=0.0, family="multinomial"
    )
    return head.fit(with_features(df, features).select("features", "label"))


def fit_fusion_head(
    df: DataFrame, left: str, right: str, width: int | tuple[int, int], num_classes: int, *, hidden: int = 512, iterations: int = 25, seed: int = 42
):
    """Concatenated vectors of ``width`` each, or of the two widths, one hidden layer, softmax output.

    Spark's perceptron uses a sigmoid hidden layer and has no dropout.
    """
    fused = df.withColumn("_fused", fuse(F.col(left), F.col(right)))
    inputs = 2 * width if isinstance(width, int) else sum(width)
    head = MultilayerPerceptronClassifier(
        layers=[inputs, hidden, num_classes], maxIter=iterations, seed=seed
    )
    return head.fit(with_features(fused, "_fused").select("features", "label"))


def score_head(model, df: DataFrame, features: str) -> DataFrame:
    """Add ``probs`` and ``pred`` from a fitted head."""
    scored = model.transform(with_features(df, features))
    return (
        scored.withColumn("probs", vector_to_array("probability"))
        .withColumn("pred", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability", "prediction")
    )


def score_fusion_head(model, df: DataFrame, left: str, right: str) -> DataFrame:
    fused = df.withColumn("_fused", fuse(F.col(left), F.col(right)))
    return score_head(model, fused, "_fused").drop("_fused")


def cross_validated(folded: DataFrame, features: str, folds: int, **settings) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a head fitted on the others.

    The folded rows are stored once; all folds are fitted in the same scans of them.
    """
    path = scratch_dir(folded.sparkSession, "folded")
    folded.write.parquet(path)
    stored = folded.sparkSession.read.schema(folded.schema).parquet(path)
    return score_by_fold(fit_fold_heads(stored, features, folds, **settings), stored, features)
