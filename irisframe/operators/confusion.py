"""Classification metrics from one pass over the predictions.

``cells`` aggregates a prediction table to at most K x K rows; every table here
derives from those rows. Partial aggregation runs before the only data-sized
shuffle, so its volume is (tasks x K x K) rows however the classes are skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: These labels appear in the tables as they are.
OVERALL = "Overall (Weighted)"
MEASURES = ("precision", "recall", "f1")
VARIANTS = ("amd", "oct", "two_stream")
# Sums of probabilities that the class tables need, per (label, pred) cell.
PROB_SUMS = ("own_sum", "own_sq", "p_count", "p_sum", "p_sq")


def ratio(a: str, b: str) -> str:
    """SQL for a / b with 0 for a zero denominator."""
    return f"coalesce(try_divide({a}, {b}), 0D)"


def cells(preds: DataFrame, *, keys: Sequence[str] = (), probs: str | None = None) -> DataFrame:
    """Counts per (label, pred), plus probability sums when ``probs`` is named."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if probs:
        own = f"get({probs}, label)"
        total = f"aggregate({probs}, 0D, (a, p) -> a + p)"
        squares = f"aggregate({probs}, 0D, (a, p) -> a + p * p)"
        values = (own, f"{own} * {own}", f"size({probs})", total, squares)
        aggs += [F.expr(f"sum({v})").alias(name) for v, name in zip(values, PROB_SUMS)]
    return preds.groupBy(*keys, "label", "pred").agg(*aggs)


def _zero_rows(like: DataFrame, classes: Sequence, fields: Sequence[str]) -> DataFrame:
    """A row of zeros per declared class, typed as in ``like``."""
    types = dict(like.dtypes)
    zeros = [f"cast(0 as {types[f]}) as {f}" for f in fields]
    classes = list(classes)
    if classes == list(range(len(classes))):
        listed = like.sparkSession.range(0, len(classes), 1, 1)
        return listed.selectExpr(f"cast(id as {types['class']}) as class", *zeros)
    one = like.sparkSession.range(0, 1, 1, 1)
    named = F.explode(F.array(*[F.lit(c).cast(types["class"]) for c in classes]))
    return one.select(named.alias("class")).selectExpr("class", *zeros)


def class_counts(
    cell: DataFrame,
    *,
    keys: Sequence[str] = (),
    classes: Sequence | None = None,
    sums: Sequence[str] = (),
) -> DataFrame:
    """Per class: true positives, support, predicted count, and the table size.

    Classes are those seen as label or prediction. With ``classes`` given,
    absent ones appear with zeros, as a declared report needs. ``sums`` are
    further cell columns to add up by label.
    """
    by_label = "".join(f", {s}" for s in sums)
    by_pred = "".join(f", cast(0 as {dict(cell.dtypes)[s]})" for s in sums)
    fields = ["support", "predicted", "tp", *sums]
    rows = cell.selectExpr(
        *keys,
        f"stack(2, label, n, 0L, if(label = pred, n, 0L){by_label}, pred, 0L, n, 0L{by_pred})"
        f" as (class, {', '.join(fields)})",
    )
    if classes is not None and not keys:
        rows = rows.unionByName(_zero_rows(rows, classes, fields))
    per_class = rows.groupBy(*keys, "class").agg(*[F.sum(f).alias(f) for f in fields])
    # At most K rows per key, so the total is a window over a handful of rows.
    return per_class.withColumn("total", F.sum("support").over(W.partitionBy(*keys)))


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; 0/0 is 0."""
    return counts.selectExpr(
        "*",
        f"{ratio('tp', 'predicted')} as precision",
        f"{ratio('tp', 'support')} as recall",
        f"{ratio('2 * tp', 'predicted + support')} as f1",
    )


def _mean_columns() -> dict[str, str]:
    """SQL of the overall figures of a class table, by name."""
    out = {"accuracy": ratio("sum(tp)", "sum(support)")}
    for m in MEASURES:
        # A declared class nobody has or predicts must not lower the macro mean.
        out[f"macro_{m}"] = f"avg(if(support > 0 or predicted > 0, {m}, null))"
        out[f"weighted_{m}"] = ratio(f"sum({m} * support)", "sum(support)")
    return out


def class_prf(preds: DataFrame, classes: Sequence | None = None) -> DataFrame:
    table = with_prf(class_counts(cells(preds), classes=classes))
    return table.select("class", *MEASURES, "support")


def confusion_matrix(preds: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """(label, pred, n) over the full K x K grid, zeros included.

    Without ``classes`` the grid spans the values seen as label or prediction.
    """
    cell = cells(preds)
    kind = cell.schema["label"].dataType
    if classes is None:
        # The grid has K x K rows by definition; one row carries the K values.
        seen = cell.select(F.explode(F.array("label", "pred")).alias("c"))
        grid = seen.agg(F.collect_set("c").alias("v"))
    else:
        listed = F.array(*[F.lit(c).cast(kind) for c in classes])
        grid = preds.sparkSession.range(0, 1, 1, 1).select(listed.alias("v"))
    grid = grid.select(F.explode("v").alias("label"), "v").select("label", F.explode("v").alias("pred"))
    zeros = grid.withColumn("n", F.lit(0).cast("long"))
    return cell.unionByName(zeros).groupBy("label", "pred").agg(F.sum("n").alias("n"))


def confusion_wide(matrix: DataFrame, classes: Sequence, other: str | None = None) -> DataFrame:
    """One row per actual class and one column per declared predicted class.

    ``other`` names a further column for predictions that are missing or not
    declared; without it, ``classes`` should be all that can be predicted.
    """
    columns = [F.coalesce(F.sum(F.when(F.col("pred") == F.lit(c), F.col("n"))), F.lit(0)).alias(str(c)) for c in classes]
    declared = F.coalesce(F.col("pred").isin(*classes), F.lit(False))
    if other is not None:
        columns.append(F.coalesce(F.sum(F.when(~declared, F.col("n"))), F.lit(0)).alias(other))
    return matrix.groupBy("label").agg(*columns)


def macro_weighted(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and the macro and support-weighted means of P, R and F1."""
    table = with_prf(class_counts(cells(preds, keys=keys), keys=keys))
    aggs = [F.expr(v).alias(k) for k, v in _mean_columns().items()]
    return table.groupBy(*keys).agg(*aggs, F.sum("support").alias("support"))


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def classification_report(
    preds: DataFrame, classes: Sequence | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """K class rows, then accuracy, macro avg and weighted avg.

    The class rows and the overall row come from one grouping-sets pass over K
    rows. The accuracy row repeats its value in every column, as a transposed
    report does. ``sort_key`` gives the printed order.
    """
    table = with_prf(class_counts(cells(preds), classes=classes))
    both = table.rollup("class").agg(
        F.grouping("class").alias("overall"),
        *[F.max(m).alias(m) for m in MEASURES],
        *[F.expr(v).alias(k) for k, v in _mean_columns().items()],
        F.expr("cast(sum(support) as double)").alias("support"),
    )
    # Labels that are numbers sort by value; others keep the report's name order.
    numeric = dict(table.dtypes)["class"] in ("int", "bigint", "smallint", "tinyint")
    key = "cast(class as bigint)" if numeric else "0L"
    if names is None:
        name = F.col("class").cast("string")
    else:
        name = F.get(F.array(*[F.lit(n) for n in names]), F.col("class"))
    last = 2**31
    means = {kind: ", ".join(f"{kind}_{m}" for m in MEASURES) for kind in ("macro", "weighted")}

    def line(name: str, sort_key: str, values: str) -> str:
        figures = ", ".join(f"'{m}', {v}" for m, v in zip((*MEASURES, "support"), values.split(", ")))
        return f"named_struct('name', {name}, 'sort_key', {sort_key}, {figures})"

    overall = ", ".join(
        [
            line("'accuracy'", f"{last}L", "accuracy, accuracy, accuracy, accuracy"),
            line("'macro avg'", f"{last + 1}L", f"{means['macro']}, support"),
            line("'weighted avg'", f"{last + 2}L", f"{means['weighted']}, support"),
        ]
    )
    own = line("_name", key, f"{', '.join(MEASURES)}, support")
    lines = f"if(overall = 1, array({overall}), array({own}))"
    return both.withColumn("_name", name).selectExpr(f"inline({lines})")


def _spread(count: str, total: str, squares: str) -> str:
    """SQL for the population standard deviation from sums of values in [0, 1]."""
    mean = f"try_divide({total}, {count})"
    return f"sqrt(greatest(try_divide({squares}, {count}) - {mean} * {mean}, 0D))"


def class_table(preds: DataFrame, variant: str, num_classes: int, probs: str = "probs") -> DataFrame:
    """The class table with an overall row, in one of three published meanings.

    ``amd``: overall accuracy on every row; std over all probabilities.
    ``oct``: one-vs-rest accuracy; std of the predicted-as-class flag, overall of
    the predicted index.
    ``two_stream``: recall as accuracy; std of a class's own probability over its
    own rows, overall the mean of those; overall P and R are numbers.
    Values are unrounded; null stands for a value the variant does not report.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    sums = () if variant == "oct" else PROB_SUMS
    cell = cells(preds, probs=probs if sums else None)
    table = with_prf(class_counts(cell, classes=range(num_classes), sums=sums))
    # Windows without keys run over the K class rows.
    acc, std, all_std = {
        "amd": (
            ratio("sum(tp) over ()", "total"),
            _spread(*[f"sum({c}) over ()" for c in ("p_count", "p_sum", "p_sq")]),
            "max(std)",
        ),
        "oct": (
            ratio("total - predicted - support + 2 * tp", "total"),
            f"sqrt({ratio('predicted', 'total')} * (1D - {ratio('predicted', 'total')}))",
            "sqrt(greatest(sum(class * class * predicted) / max(total)"
            " - pow(sum(class * predicted) / max(total), 2), 0D))",
        ),
        "two_stream": (
            "recall",
            f"coalesce({_spread('support', 'own_sum', 'own_sq')}, 0D)",
            "avg(std)",
        ),
    }[variant]
    table = table.selectExpr("*", f"{acc} as class_accuracy", f"{std} as std")
    means = _mean_columns()
    both = table.rollup("class").agg(
        F.grouping("class").alias("overall"),
        *[F.max(m).alias(m) for m in (*MEASURES, "class_accuracy", "std")],
        *[F.expr(means[k]).alias(k) for k in ("accuracy", *[f"weighted_{m}" for m in MEASURES])],
        F.expr(all_std).alias("all_std"),
    )
    overall_pr = ("weighted_precision", "weighted_recall")
    p, r = overall_pr if variant == "two_stream" else ("cast(null as double)",) * 2
    return both.selectExpr(
        f"if(overall = 1, {num_classes}, class) as sort_key",
        f"if(overall = 1, '{OVERALL}', cast(class as string)) as class",
        "if(overall = 1, accuracy, class_accuracy) as accuracy",
        f"if(overall = 1, {p}, precision) as precision",
        f"if(overall = 1, {r}, recall) as recall",
        "if(overall = 1, weighted_f1, f1) as f1",
        "if(overall = 1, all_std, std) as std",
    )


def formatted_class_table(table: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The printed view: four decimals, N/A and a plus-minus sign before the std."""
    label = F.col("class")
    if names is not None:
        listed = F.get(F.array(*[F.lit(n) for n in names]), F.col("sort_key"))
        label = F.coalesce(listed, label)
    figures = ("accuracy", *MEASURES)
    text = [f"if({c} is null, 'N/A', format_string('%.4f', {c})) as {c}" for c in figures]
    shown = table.withColumn("class", label)
    return shown.selectExpr("sort_key", "class", *text, "format_string('±%.4f', std) as std")
