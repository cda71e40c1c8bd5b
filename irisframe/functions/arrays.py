"""Element-wise losses over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mse_to_constant(values: Column, target: float) -> Column:
    """Mean squared distance of an array from one constant (least-squares GAN)."""
    return _total(F.transform(values, lambda x: (x - target) * (x - target))) / F.size(values)


def mean_abs_error(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def adversarial_loss(prediction: Column, target_is_real: bool) -> Column:
    return mse_to_constant(prediction, 1.0 if target_is_real else 0.0)


def discriminator_loss(pred_real: Column, pred_fake: Column) -> Column:
    return F.lit(0.5) * (adversarial_loss(pred_real, True) + adversarial_loss(pred_fake, False))


def fuse(a: Column, b: Column) -> Column:
    """Feature fusion: one vector after the other."""
    return F.concat(a, b)
