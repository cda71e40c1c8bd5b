"""ROC and precision-recall curves, areas and averages, one class against the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ROWS_PER_BUCKET, Scan, prefix_scan, with_next


def scores_from_probs(preds: DataFrame, *, keys: Sequence[str] = (), probs: str = "probs") -> DataFrame:
    """Long form (class, score, hit): one narrow row per sample and class."""
    # The outer form keeps Spark from deriving a "not empty" filter, which would be
    # pushed below the scoring projections and compute the scores twice.
    long = preds.select(*keys, "label", F.posexplode_outer(probs).alias("class", "score"))
    long = long.filter(F.col("class").isNotNull())
    return long.select(*keys, "class", "score", (F.col("label") == F.col("class")).alias("hit"))


def _usable() -> Column:
    return F.col("score").isNotNull() & ~F.isnan("score") & F.col("hit").isNotNull()


def rejected_scores(scores: DataFrame) -> DataFrame:
    """Rows that no curve counts, with a reason: no score, NaN, or no label."""
    reason = F.when(F.col("score").isNull(), "no score").when(F.isnan("score"), "NaN score").otherwise("no label")
    return scores.filter(~_usable()).withColumn("reason", reason)


def cumulative(
    scores: DataFrame, *, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, totals: bool = True, thin: str | None = None
) -> DataFrame:
    """Per distinct score: positives, negatives, running TP / FP by falling score,
    and, with ``totals``, the class totals ``p`` and ``q`` that the curves need.
    ``thin`` drops what a drawing of that curve does not need, see ``thinned``; areas
    are for curves with all their points.

    Equal scores are merged before anything is ordered, so a score shared by a
    third of all rows is one row in the scan. Null and NaN scores and null labels
    are left out; ``rejected_scores`` names them.
    """
    group = [*keys, "class"]
    hit = F.col("hit").cast("long")
    slim = scores.withColumn("score", F.col("score").cast("double")).filter(_usable()).withColumn("_down", -F.col("score"))
    points = slim.groupBy(*group, "_down").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    ran = prefix_scan(
        points,
        group,
        ["_down"],
        {"tp": Scan("sum", F.col("pos")), "fp": Scan("sum", F.col("neg"))},
        rows_per_bucket=rows_per_bucket,
        totals={"tp": "p", "fp": "q"} if totals else None,
        keep_bucket=thin is not None,
    )
    kept = ran if thin is None else thinned(ran, group, thin)
    return kept.withColumn("score", -F.col("_down")).drop("_down")


def thinned(ran: DataFrame, group: Sequence[str], curve: str) -> DataFrame:
    """The points that shape a curve, each class's first and last among them.

    "roc" drops a point whose next step equals its own: the line goes straight on, so
    the area stays. "pr" drops a point that neither it nor the next one adds a true
    positive to: recall stands still before and after it.
    """
    if curve not in ("roc", "pr"):
        raise ValueError(f"curve must be roc or pr, not {curve!r}")
    near = with_next(ran, group, ["_down"], {"pos": "_pos", "neg": "_neg"})
    if curve == "roc":
        turns = (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
    else:
        turns = (F.col("pos") > 0) | (F.col("_pos") > 0)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return near.filter(F.col("_pos").isNull() | first | turns).drop("_pos", "_neg", "_bucket")


def cumulative_from_column(
    df: DataFrame, label: str, score: str, classes: Sequence, *, rows_per_bucket: int = ROWS_PER_BUCKET, totals: bool = True
) -> DataFrame:
    """``cumulative`` for one score column judged against every declared class.

    The order is the same for all classes: rows are merged by score and scanned
    once with a counter per class, and only the result is spread over classes.
    """
    slim = df.select(F.col(label).alias("label"), F.col(score).cast("double").alias("score"))
    slim = slim.withColumn("hit", F.col("label").isNotNull()).filter(_usable() & F.col("hit"))
    counts = {f"_n{i}": F.count(F.when(F.col("label") == F.lit(c), 1)) for i, c in enumerate(classes)}
    points = slim.groupBy((-F.col("score")).alias("_down")).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in counts.items()])
    names = ["_n", *counts]
    scans = {f"_r{n}": Scan("sum", F.col(n)) for n in names}
    ends = {f"_r{n}": f"_t{n}" for n in names} if totals else None
    ran = prefix_scan(points, [], ["_down"], scans, rows_per_bucket=rows_per_bucket, totals=ends)
    each = [
        F.struct(
            F.lit(c).alias("class"),
            F.col(n).alias("pos"),
            (F.col("_n") - F.col(n)).alias("neg"),
            F.col(f"_r{n}").alias("tp"),
            (F.col("_r_n") - F.col(f"_r{n}")).alias("fp"),
            *([F.col(f"_t{n}").alias("p"), (F.col("_t_n") - F.col(f"_t{n}")).alias("q")] if totals else []),
        )
        for n, c in zip(counts, classes)
    ]
    return ran.select((-F.col("_down")).alias("score"), F.inline(F.array(*each)))


def curve_areas(running: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision and support per class.

    AUC is the trapezoid over distinct scores (ties count half); null without
    both positives and negatives. Average precision is the step sum.
    """
    d = lambda c: F.col(c).cast("double")
    trapezoid = F.sum(d("neg") * (2 * d("tp") - d("pos")) / 2)
    steps = F.sum(F.try_divide(d("pos") * d("tp"), d("tp") + d("fp")))
    out = running.groupBy(*keys, "class").agg(
        F.try_divide(trapezoid, F.sum(d("pos")) * F.sum(d("neg"))).alias("auc"),
        F.try_divide(steps, F.sum(d("pos"))).alias("ap"),
        F.sum("pos").alias("support"),
        F.sum("neg").alias("others"),
    )
    return out


def macro_weighted_auc(areas: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    support = F.when(F.col("auc").isNotNull(), F.col("support"))
    aggs = [
        F.avg("auc").alias("macro_auc"),
        (F.sum(F.col("auc") * F.col("support")) / F.sum(support)).alias("weighted_auc"),
    ]
    return areas.groupBy(*keys).agg(*aggs) if keys else areas.agg(*aggs)


def roc_points(running: DataFrame) -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, and the start (inf, 0, 0)."""
    point = {
        "threshold": F.col("score"),
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("q").cast("double")),
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")),
    }
    return _with_end(running, point, {"threshold": float("inf"), "fpr": 0.0, "tpr": 0.0})


def pr_points(running: DataFrame) -> DataFrame:
    """(class, threshold, precision, recall) per distinct score, and the end (null, 1, 0)."""
    point = {
        "threshold": F.col("score"),
        "precision": (F.col("tp") / (F.col("tp") + F.col("fp"))).cast("double"),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")),
    }
    return _with_end(running, point, {"threshold": None, "precision": 1.0, "recall": 0.0})


def _with_end(running: DataFrame, point: dict[str, Column], end: dict[str, float | None]) -> DataFrame:
    """A class's first row, known by its counts, also gives the curve's end."""
    here = F.struct(*[c.alias(n) for n, c in point.items()])
    beyond = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in end.items()])
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    rows = F.when(first, F.array(beyond, here)).otherwise(F.array(here))
    return running.select("class", F.inline(rows))
