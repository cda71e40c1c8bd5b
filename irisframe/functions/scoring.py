"""Per-row scoring of a vector of class logits.

Functions take column names. Where the number of classes is known, expressions
are unrolled as SQL text: they compile into the stage, while array lambdas are
interpreted per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_exps(df: DataFrame, logits: str, num_classes: int | None) -> DataFrame:
    """Add ``_exps`` (logits shifted by their maximum, exponentiated) and their
    sum ``_sum``, which is null or NaN exactly when the row cannot be scored."""
    if num_classes is None:
        z = F.col(logits)
        # The maximum is a second argument, not part of the lambda, so that it is
        # computed once per row.
        tops = F.array_repeat(F.array_max(z), F.size(z))
        staged = df.withColumn("_exps", F.zip_with(z, tops, lambda v, top: F.exp(v - top)))
        total = f"if(size(`{logits}`) > 0, aggregate(_exps, 0D, (a, x) -> a + x), null)"
    else:
        each = range(num_classes)
        exps = ", ".join(f"exp(get(`{logits}`, {k}) - array_max(`{logits}`))" for k in each)
        staged = df.withColumn("_exps", F.expr(f"array({exps})"))
        sums = " + ".join(f"get(_exps, {k})" for k in each)
        total = f"if(size(`{logits}`) = {num_classes}, {sums}, null)"
    # A one-row generator. Filters on its output are not pushed below it, where
    # they would repeat everything the logits were computed from.
    return staged.withColumn("_total", F.expr(total)).select("*", F.expr("explode(array(_total)) as _sum"))


def _shares(staged: DataFrame, num_classes: int | None, name: str) -> DataFrame:
    if num_classes is None:
        divisor = F.array_repeat(F.col("_sum"), F.size("_exps"))
        probs = F.zip_with(F.col("_exps"), divisor, lambda e, t: e / t)
    else:
        probs = F.expr("array(" + ", ".join(f"get(_exps, {k}) / _sum" for k in range(num_classes)) + ")")
    return staged.withColumn(name, probs).drop("_exps", "_total", "_sum")


def with_softmax(df: DataFrame, logits: str, num_classes: int | None = None, name: str = "probs") -> DataFrame:
    """Add the stable softmax of ``logits``; unrolled when ``num_classes`` is given."""
    return _shares(_with_exps(df, logits, num_classes), num_classes, name)


def argmax(values: str) -> Column:
    """Zero-based position of the maximum; the lowest position wins a tie."""
    return F.expr(f"cast(array_position(`{values}`, array_max(`{values}`)) - 1 as int)")


def log_sum_exp(logits: str, num_classes: int | None = None) -> Column:
    top = f"array_max(`{logits}`)"
    if num_classes is not None:
        exps = " + ".join(f"exp(get(`{logits}`, {k}) - {top})" for k in range(num_classes))
        return F.expr(f"{top} + ln({exps})")
    z = F.col(logits)
    shifted = F.zip_with(z, F.array_repeat(F.array_max(z), F.size(z)), lambda v, t: v - t)
    return F.array_max(z) + F.log(F.aggregate(shifted, F.lit(0.0), lambda a, v: a + F.exp(v)))


def cross_entropy(
    logits: str, label: str, smoothing: float = 0.0, num_classes: int | None = None
) -> Column:
    """Negative log likelihood of the label, with the given share of the target
    spread evenly over all classes."""
    lse = log_sum_exp(logits, num_classes)
    nll = lse - F.get(F.col(logits), F.col(label))
    if smoothing == 0.0:
        return nll
    if num_classes is not None:
        total = F.expr(" + ".join(f"get(`{logits}`, {k})" for k in range(num_classes)))
    else:
        total = F.aggregate(F.col(logits), F.lit(0.0), lambda a, z: a + z)
    return F.lit(1.0 - smoothing) * nll + F.lit(smoothing) * (lse - total / F.size(logits))


def one_hot(label: Column, num_classes: int) -> Column:
    return F.array(*[(label == k).cast("int") for k in range(num_classes)])


def scored_rows(df: DataFrame, logits: str = "logits", num_classes: int | None = None, label: str = "label") -> DataFrame:
    """Every row with ``probs``, ``pred`` and ``reason``, scored once.

    ``reason`` is null for good rows. It names unusable logits (missing, of the
    wrong number, null or NaN) and, where there is a label column, labels that are
    missing or out of range.
    """
    staged = _with_exps(df, logits, num_classes)
    reason = F.when(F.col("_sum").isNull() | F.isnan("_sum"), "unusable logits")
    if label in df.columns:
        size = F.size(logits) if num_classes is None else F.lit(num_classes)
        outside = (F.col(label) < 0) | (F.col(label) >= size)
        reason = reason.when(F.col(label).isNull(), "no label").when(outside, "label out of range")
    scored = _shares(staged.withColumn("reason", reason), num_classes, "probs")
    return scored.withColumn("pred", argmax("probs"))


def score_predictions(
    df: DataFrame, logits: str = "logits", num_classes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): ``scored_rows`` parted by its reason.

    The two are separate queries; to use both, write ``scored_rows`` and filter it.
    """
    rows = scored_rows(df, logits, num_classes)
    good = rows.filter(F.col("reason").isNull()).drop("reason")
    return good, rows.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")
