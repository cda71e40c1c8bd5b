"""Analysis of run logs: best so far, early stopping, plateau steps, phases.

A run may hold a large share of the log, so ordered work goes through
:func:`~irisframe.operators.ordered.prefix_scan`. Stopping rules look only at
rows that can improve on the best value, found in parallel first; rules with a
threshold follow these by :mod:`~irisframe.operators.successors`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARLY_STOP_PATIENCE, PLATEAU, PlateauSettings
from .ordered import ROWS_PER_BUCKET, Scan, prefix_scan
from .successors import follow_improvements


def _log(df: DataFrame, run: str, epoch: str, value: str, mode: str) -> DataFrame:
    """run, epoch, score (larger is better) and rank: the score where it can
    improve on another, null where it is NaN or missing."""
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be max or min, not {mode!r}")
    v = F.col(value).cast("double")
    score = v if mode == "max" else -v
    log = df.select(F.col(run).alias("run"), F.col(epoch).alias("epoch"), score.alias("score"))
    return log.withColumn("rank", F.when(~F.isnan("score"), F.col("score")))


def _scored(log: DataFrame, rows_per_bucket: int, step: Column | None = None) -> DataFrame:
    """The log with each row's position, the sum of ``step`` (1) up to it, and the best
    rank before it."""
    scans = {
        "pos": Scan("sum", F.lit(1).cast("long") if step is None else step),
        "before": Scan("max", F.col("rank"), inclusive=False),
    }
    return prefix_scan(log, ["run"], ["epoch"], scans, rows_per_bucket=rows_per_bucket)


def best_so_far(
    df: DataFrame,
    run: str,
    epoch: str,
    value: str,
    *,
    mode: str = "max",
    initial: float | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per epoch: best value up to it and whether it strictly improved.

    ``initial`` is the best value before the first epoch: 0 by default in max
    mode (accuracies), infinity in min mode (losses). A NaN or missing value
    never improves.
    """
    scored = _scored(_log(df, run, epoch, value, mode), rows_per_bucket)
    sign = 1.0 if mode == "max" else -1.0
    if initial is None:
        initial = 0.0 if mode == "max" else float("inf")
    start = F.lit(sign * initial)
    before = F.greatest(F.col("before"), start)
    return scored.select(
        F.col("run").alias(run),
        F.col("epoch").alias(epoch),
        (F.col("score") * sign).alias("value"),
        (F.greatest(before, F.col("rank")) * sign).alias("best"),
        F.coalesce(F.col("rank") > before, F.lit(False)).alias("improved"),
    )


def early_stop(
    df: DataFrame,
    run: str,
    epoch: str,
    value: str,
    *,
    mode: str = "max",
    delta: float = 0.0,
    patience: int = EARLY_STOP_PATIENCE,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per run: best value, final counter, and the epoch it stopped at (null if not).

    Epochs after the stop are ignored. The first value sets the best; later
    ones improve only beyond ``delta``. NaN and missing values never improve, and
    nothing improves on a first value of that kind.
    """
    state = early_stop_state(
        df, run, epoch, value, mode=mode, delta=delta, patience=patience, rows_per_bucket=rows_per_bucket
    )
    return state.drop("last_epoch")


def early_stop_state(
    df: DataFrame,
    run: str,
    epoch: str,
    value: str,
    *,
    mode: str = "max",
    delta: float = 0.0,
    patience: int = EARLY_STOP_PATIENCE,
    earlier: DataFrame | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """:func:`early_stop` with each run's ``last_epoch``, from which it can go on.

    ``earlier`` is such a result for the epochs before those of ``df``: its runs go on
    with their best and counter, also those without new rows. Rows of stopped runs, and
    epochs not after a run's last one, are ignored. The result equals one over all
    epochs at once.
    """
    if delta < 0:
        raise ValueError("delta must not be negative")
    sign = 1.0 if mode == "max" else -1.0
    log = _log(df, run, epoch, value, mode)
    if earlier is None:
        scored = _scored(log, rows_per_bucket).withColumn("reach", F.col("pos"))
    else:
        going = F.col("stop_epoch").isNull()
        known = earlier.select(F.col(run).alias("_run"), "stop_epoch", "last_epoch")
        new = going & (F.col("last_epoch").isNull() | (F.col("epoch") > F.col("last_epoch")))
        log = log.join(known, F.col("run").eqNullSafe(F.col("_run")), "left").filter(new).select(*log.columns)
        # The best so far opens the new part of a run, as far back as it was found.
        best, idle = F.col("best") * sign, F.col("counter")
        usable = F.when(~F.isnan("best"), best)
        opening = earlier.filter(going).select(
            F.col(run).alias("run"), F.col("last_epoch").alias("epoch"), best.alias("score"), usable.alias("rank"), idle.alias("idle")
        )
        both = log.withColumn("idle", F.lit(None).cast("long")).unionByName(opening)
        idle = F.coalesce("idle", F.lit(0))
        # The pause before the new part moves its rows on, but not the opening itself.
        scored = _scored(both, rows_per_bucket, 1 + idle)
        scored = scored.withColumn("reach", F.col("pos")).withColumn("pos", F.col("pos") - idle).drop("idle")
    out = _stop_by_successors(scored, delta, patience, rows_per_bucket)
    # A run that starts without a usable score keeps it as its best for ever.
    hopeless = F.col("first.rank").isNull()
    state = out.select(
        F.col("run").alias(run),
        (F.when(hopeless, F.col("first.score")).otherwise(F.col("best")) * sign).alias("best"),
        F.when(hopeless, F.least(F.col("n") - 1, F.lit(patience))).otherwise(F.col("counter")).cast("long").alias("counter"),
        F.when(hopeless, F.col("idle_end")).otherwise(F.col("stop_epoch")).alias("stop_epoch"),
        "last_epoch",
    )
    return state if earlier is None else state.unionByName(earlier.filter("stop_epoch IS NOT NULL").select(*state.columns))


def _firsts(patience: int) -> list[Column]:
    """Aggregates per run: its first row, length, last epoch, and the epoch where a run
    without any improvement ends."""
    first = F.when(F.col("pos") == 1, F.struct("score", "rank"))
    return [
        F.first(first, ignorenulls=True).alias("first"),
        F.max("reach").alias("n"),
        F.max("epoch").alias("last_epoch"),
        F.max(F.when(F.col("pos") == 1 + patience, F.col("epoch"))).alias("idle_end"),
    ]


def _records() -> Column:
    return F.col("rank").isNotNull() & ((F.col("pos") == 1) | (F.col("rank") > F.col("before")))


def _candidates(scored: DataFrame, may: Column, head: Column) -> DataFrame:
    """The rows that may improve; ``head`` is true where a row sets its run's first best."""
    return scored.filter(may).select("run", "pos", F.col("rank").alias("score"), head.alias("head"))


def _stop_by_successors(scored: DataFrame, delta: float, patience: int, rows_per_bucket: int) -> DataFrame:
    """An improvement is always a strict record, but with delta > 0 not every record
    is one: follow each to the first beyond ``delta``."""
    walked = follow_improvements(
        _candidates(scored, _records(), F.col("pos") == 1), lambda best: best + delta, patience, rows_per_part=rows_per_bucket
    ).withColumnRenamed("run", "_run")
    runs = scored.groupBy("run").agg(*_firsts(patience))
    ended = runs.join(walked, F.col("run").eqNullSafe(F.col("_run")), "left").withColumn(
        "wait_from",
        F.when(F.col("at_pos").isNotNull(), F.col("at_pos")).when(F.col("n") - F.col("pos") >= patience, F.col("pos")),
    )
    stops = ended.select(
        F.col("run").alias("_run"),
        "first",
        "n",
        "last_epoch",
        "idle_end",
        F.coalesce("at_best", "best").alias("best"),
        F.when(F.col("wait_from").isNotNull(), F.lit(patience)).otherwise(F.col("n") - F.col("pos")).alias("counter"),
        (F.col("wait_from") + patience).alias("_pos"),
    )
    # (run, pos) is unique, so this join spreads even a dominant run evenly.
    named = scored.select("run", "pos", F.col("epoch").alias("stop_epoch"))
    same = F.col("_run").eqNullSafe(F.col("run")) & (F.col("_pos") == F.col("pos"))
    return stops.join(named, same, "left").drop("run").withColumnRenamed("_run", "run")


def plateau_rate(
    df: DataFrame,
    run: str,
    epoch: str,
    value: str,
    *,
    settings: PlateauSettings = PLATEAU,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per run: best value, number of rate cuts and the final rate (max mode).

    The rate is cut after more than ``patience`` epochs in a row without a
    relative gain of ``threshold``; the count then starts again. NaN and missing
    values are epochs without gain; a run of them alone has a best of -infinity.
    """
    scored = _scored(_log(df, run, epoch, value, "max"), rows_per_bucket)
    # While the best is positive only strict records can improve on it. Up to
    # the first positive value every row with a score stays a candidate.
    before = F.col("before")
    usable = F.col("rank") > float("-inf")
    head = before.isNull() | (before == float("-inf"))
    may = usable & (head | (F.col("rank") > before) | (before <= 0))
    gain = 1.0 + settings.threshold
    cycle = settings.patience + 1
    walked = follow_improvements(
        _candidates(scored, may, head), lambda best: best * gain, cycle, rows_per_part=rows_per_bucket
    ).withColumnRenamed("run", "_run")
    runs = scored.groupBy("run").agg(F.max("pos").alias("n"))
    since = F.col("n") - F.coalesce("pos", F.lit(0))
    cuts = F.coalesce("waits", F.lit(0)) + F.floor(since / cycle)
    rate = F.lit(settings.initial_rate) * F.pow(F.lit(settings.factor), F.col("cuts"))
    return (
        runs.join(walked, F.col("run").eqNullSafe(F.col("_run")), "left")
        .withColumn("cuts", cuts)
        .select(
            F.col("run").alias(run),
            F.coalesce("best", F.lit(float("-inf"))).alias("best"),
            F.col("cuts").cast("long").alias("cuts"),
            F.greatest(rate, F.lit(settings.floor)).alias("rate"),
            F.col("n").alias("epochs"),
        )
    )


def best_epoch(df: DataFrame, run: str, epoch: str, value: str, *, mode: str = "max") -> DataFrame:
    """Per run: best value and its first epoch, and the last epoch with its value.
    NaN and missing values are never best; a run of them alone has none."""
    log = _log(df, run, epoch, value, mode)
    sign = 1.0 if mode == "max" else -1.0
    first_best = F.when(F.col("rank").isNotNull(), F.struct("rank", (-F.col("epoch")).alias("neg_epoch")))
    return log.groupBy("run").agg(
        F.max(first_best).alias("_b"),
        F.max("epoch").alias("last_epoch"),
        F.max_by("score", "epoch").alias("_l"),
        F.count(F.lit(1)).alias("epochs"),
    ).select(
        F.col("run").alias(run),
        (F.col("_b")["rank"] * sign).alias("best"),
        (-F.col("_b")["neg_epoch"]).alias("best_epoch"),
        "last_epoch",
        (F.col("_l") * sign).alias("last_value"),
        "epochs",
    )


def with_phase(df: DataFrame, epoch: str, unfreeze_at: int) -> DataFrame:
    """Add ``phase``: the head alone trains before ``unfreeze_at``, everything after."""
    return df.withColumn("phase", F.when(F.col(epoch) >= unfreeze_at, "full").otherwise("head"))


def minutes_per_run(df: DataFrame, keys: str | Sequence[str], ts: str) -> DataFrame:
    """Elapsed minutes between the first and last log time of each run, or of each
    (run, epoch) or other list of keys."""
    # An interval, taken apart: the same for either timestamp type and any
    # session time zone.
    span = f"(max({ts}) - min({ts}))"
    parts = (("DAY", "* 1440"), ("HOUR", "* 60"), ("MINUTE", ""), ("SECOND", "/ 60D"))
    minutes = " + ".join(f"extract({unit} FROM {span}) {scale}" for unit, scale in parts)
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(F.expr(f"cast({minutes} as double)").alias("minutes"))
