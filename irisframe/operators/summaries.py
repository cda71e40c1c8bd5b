"""Batch losses, cross-validation tables and final summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOSSES, LossSettings
from ..functions.arrays import adversarial_loss, mean_abs_error
from .confusion import macro_weighted
from .curves import cumulative, curve_areas, macro_weighted_auc, scores_from_probs

CV_METRICS = ("accuracy", "precision", "recall", "macro_f1", "roc_auc")


def mean_of_batch_means(df: DataFrame, loss: Column, batch: str = "batch_id") -> DataFrame:
    """The loss a training loop reports (a short last batch counts as much as a
    full one), next to the plain sample mean."""
    per_batch = df.groupBy(batch).agg(
        F.avg(loss).alias("_m"), F.sum(loss).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    return per_batch.agg(
        F.avg("_m").alias("batch_mean_loss"),
        (F.sum("_s") / F.sum("_n")).alias("sample_mean_loss"),
        F.count(F.lit(1)).alias("batches"),
        F.sum("_n").alias("samples"),
    )


def generator_losses(df: DataFrame, settings: LossSettings = LOSSES) -> DataFrame:
    """Four loss columns per sample from the eight arrays of a translation step."""
    c = F.col
    gan = adversarial_loss(c("pred_fake_b"), True) + adversarial_loss(c("pred_fake_a"), True)
    cycle = mean_abs_error(c("recov_a"), c("real_a")) + mean_abs_error(c("recov_b"), c("real_b"))
    same = mean_abs_error(c("same_a"), c("real_a")) + mean_abs_error(c("same_b"), c("real_b"))
    parts = df.withColumns({"loss_gan": gan, "loss_cycle": cycle, "loss_identity": same})
    weighted = settings.cycle_weight * c("loss_cycle") + settings.identity_weight * c("loss_identity")
    return parts.withColumn("total_loss", c("loss_gan") + weighted)


def cv_results(preds: DataFrame, fold: str = "fold") -> DataFrame:
    """Accuracy, macro P/R/F1 and macro one-vs-rest AUC per fold."""
    prf = macro_weighted(preds, [fold]).select(
        fold,
        "accuracy",
        F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"),
        "macro_f1",
    )
    running = cumulative(scores_from_probs(preds, keys=[fold]), keys=[fold], totals=False)
    auc = macro_weighted_auc(curve_areas(running, [fold]), [fold])
    return prf.join(auc.select(fold, F.col("macro_auc").alias("roc_auc")), fold)


def cv_means(results: DataFrame) -> DataFrame:
    """Column means over folds, without the fold number itself."""
    return results.agg(*[F.avg(m).alias(m) for m in CV_METRICS])


def summary_parts(preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of P/R/F1 averages, one row of AUC averages)."""
    running = cumulative(scores_from_probs(preds), totals=False)
    return macro_weighted(preds), macro_weighted_auc(curve_areas(running))


def summary_long(one_row: DataFrame, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """(metric, value) rows from a one-row table; ``metrics`` pairs name and column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in metrics])
    return one_row.select(F.explode(pairs).alias("r")).select("r.*")
