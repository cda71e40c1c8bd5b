"""Run-log rules against a direct walk over each run."""

import random

import numpy as np
import pytest

from irisframe.config import PLATEAU
from irisframe.operators import runlog, successors


def logs():
    rng = random.Random(11)
    runs = {f"r{i}": [round(rng.gauss(0, 3), 2) for _ in range(rng.randrange(1, 60))] for i in range(30)}
    runs["rising"] = [i / 100 for i in range(1, 400)]
    runs["falling"] = [-i / 100 for i in range(1, 200)]
    runs["flat"] = [1.0] * 100
    runs["one"] = [0.5]
    runs["slow"] = [1 + i * 1e-5 for i in range(300)]
    # Below zero a relative gain lets the best fall.
    runs["sinking"] = [-1 - i * 1e-5 * rng.randrange(3) for i in range(300)] + [0.0, -1.0, 0.0, 2.0, 2.0001, 2.001]
    runs["unset"] = [float("-inf")] * 15 + [-3.0, -2.0, float("inf"), 5.0]
    return runs


@pytest.fixture(scope="module")
def table(spark):
    rows = [(run, 10 * e + 3, v) for run, vals in logs().items() for e, v in enumerate(vals)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "run string, epoch long, value double").cache()


def walk_stop(values, mode, delta, patience):
    best, counter, stop = None, 0, None
    for e, v in enumerate(values):
        if best is None:
            best = v
        elif (v > best + delta) if mode == "max" else (v < best - delta):
            best, counter = v, 0
        else:
            counter += 1
            if counter >= patience:
                stop = 10 * e + 3
                break
    return best, counter, stop


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
@pytest.mark.parametrize("mode, delta, patience", [("max", 0, 6), ("min", 0, 3), ("max", 0.5, 4), ("min", 1.5, 2), ("max", 0.005, 3)])
def test_early_stop(table, mode, delta, patience, rows_per_bucket):
    got = runlog.early_stop(
        table, "run", "epoch", "value", mode=mode, delta=delta, patience=patience, rows_per_bucket=rows_per_bucket
    ).collect()
    want = {run: walk_stop(v, mode, delta, patience) for run, v in logs().items()}
    assert {r.run: (r.best, r.counter, r.stop_epoch) for r in got} == want


def walk_plateau(values):
    best, bad, rate, cuts = float("-inf"), 0, PLATEAU.initial_rate, 0
    for v in values:
        if v > best * (1 + PLATEAU.threshold):
            best, bad = v, 0
        else:
            bad += 1
        if bad > PLATEAU.patience:
            rate, bad, cuts = max(rate * PLATEAU.factor, PLATEAU.floor), 0, cuts + 1
    return best, cuts, rate


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
def test_plateau(table, rows_per_bucket):
    got = {r.run: r for r in runlog.plateau_rate(table, "run", "epoch", "value", rows_per_bucket=rows_per_bucket).collect()}
    for run, values in logs().items():
        best, cuts, rate = walk_plateau(values)
        assert (got[run].best, got[run].cuts, got[run].epochs) == (best, cuts, len(values)), run
        assert got[run].rate == pytest.approx(rate)


def test_first_above_equals_a_search():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 64, 301):
        values = rng.integers(0, 40, size).astype(float)
        start, bound = rng.integers(0, size + 1, 200), rng.integers(-1, 41, 200).astype(float)
        want = [next((j for j in range(a, size) if values[j] > b), size) for a, b in zip(start, bound)]
        assert successors.first_above(values, start, bound).tolist() == want


@pytest.mark.parametrize("delta", [0.5, 7.0, 150.0])
def test_one_run_that_always_rises_is_cut(spark, delta):
    # Every row is a record; a third of the log or all of it must not meet in a task.
    rows, part = 6000, 250
    values = [float(i % 7 + i) for i in range(rows)]
    log = spark.createDataFrame([(None, 10 * e + 3, v) for e, v in enumerate(values)], "run string, epoch long, value double")
    got = runlog.early_stop(log, "run", "epoch", "value", delta=delta, patience=200, rows_per_bucket=part).collect()
    assert [(r.best, r.counter, r.stop_epoch) for r in got] == [walk_stop(values, "max", delta, 200)]
    records = log.selectExpr("run", "(epoch - 3) div 10 + 1 AS pos", "value AS score", "epoch = 3 AS head")
    cut = records.repartitionByRange(rows // part, "run", "pos").rdd.glom().map(len).collect()
    assert max(cut) < 2 * part
    entries = successors._entries(records, rows // part, lambda best: best + delta, 200)
    assert entries.filter("head").count() == 1 and entries.select("part").distinct().count() == rows // part


def test_runs_without_records_are_left_out(spark):
    none = spark.createDataFrame([], "run string, pos long, score double, head boolean")
    assert successors.follow_improvements(none, lambda best: best + 1, 3).collect() == []


@pytest.mark.parametrize("mode", ["max", "min"])
def test_best_so_far(table, mode):
    got = {(r.run, r.epoch): r for r in runlog.best_so_far(table, "run", "epoch", "value", mode=mode, rows_per_bucket=100).collect()}
    for run, values in logs().items():
        best = 0.0 if mode == "max" else float("inf")
        for e, v in enumerate(values):
            better = v > best if mode == "max" else v < best
            best = v if better else best
            assert (got[(run, 10 * e + 3)].best, got[(run, 10 * e + 3)].improved) == (best, better)


def test_best_epoch_takes_the_first_of_equal_values(table):
    got = {r.run: r for r in runlog.best_epoch(table, "run", "epoch", "value").collect()}
    for run, values in logs().items():
        assert (got[run].best, got[run].best_epoch) == (max(values), 10 * values.index(max(values)) + 3)
        assert got[run].last_value == values[-1]


def test_phase_and_bad_arguments(table):
    phases = {r.epoch: r.phase for r in runlog.with_phase(table, "epoch", 53).collect()}
    assert phases[43] == "head" and phases[53] == "full"
    with pytest.raises(ValueError):
        runlog.early_stop(table, "run", "epoch", "value", delta=-1)
    with pytest.raises(ValueError):
        runlog.early_stop(table, "run", "epoch", "value", mode="best")
