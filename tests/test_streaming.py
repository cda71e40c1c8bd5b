import random

import pytest
from pyspark.sql import functions as F

from irisframe.operators import runlog
from irisframe.streaming import early_stop as live
from irisframe.streaming import incremental
from tests.conftest import png


def test_each_row_appears_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.range(1).schema
    for batch in (range(0, 5), range(5, 9), None):
        if batch is not None:
            spark.createDataFrame([(i,) for i in batch], schema).write.mode("append").parquet(src)
        stream = incremental.table_stream(spark, src, schema, files_per_batch=2)
        incremental.run_pending(stream, lambda df: df.select((F.col("id") * 2).alias("v")), out, state)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [2 * i for i in range(9)]


def test_single_file_source(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(7).coalesce(1).write.parquet(str(src))
    (part,) = src.glob("*.parquet")
    stream = incremental.table_stream(spark, str(part), spark.range(1).schema)
    incremental.run_pending(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_new_images_only(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        png(tmp_path / "in" / f"c{i % 2}" / f"{i}.png", [[(i, i, i)]])
        incremental.run_pending(incremental.image_stream(spark, str(tmp_path / "in")), lambda df: df, out, state)
    rows = spark.read.parquet(out).collect()
    assert sorted((r["class"], r.name) for r in rows) == [("c0", "0.png"), ("c0", "2.png"), ("c1", "1.png")]


def watch(spark, folder, schema, **settings):
    stream = incremental.table_stream(spark, f"{folder}/in", schema)
    live.run_early_stop(stream, "run", "epoch", "value", f"{folder}/out", f"{folder}/state", **settings)
    return live.current_runs(spark, f"{folder}/out")


def plain(rows):
    """Rows that compare, NaN included."""
    return sorted((repr(r.run), repr(r.best), r.counter, repr(r.stop_epoch)) for r in rows)


@pytest.mark.parametrize("mode, delta, patience", [("max", 0.0, 6), ("min", 0.3, 3)])
def test_stream_equals_batch(spark, tmp_path, mode, delta, patience):
    rng = random.Random(2)
    odd = [float("nan"), None, float("inf"), float("-inf")]
    rows = [(run, e, round(rng.gauss(0, 2), 2)) for run in range(9) for e in range(rng.randrange(1, 40))]
    rows += [(run, e, rng.choice([*odd, 1.0, 2.0])) for run in range(10, 16) for e in range(rng.randrange(1, 40))]
    rows += [(None, e, float(e % 5 + e)) for e in range(40)]
    df = spark.createDataFrame(rows, "run long, epoch long, value double")
    settings = {"mode": mode, "delta": delta, "patience": patience}
    for low in (0, 10, 20, 30):  # epochs arrive in order, shuffled inside an arrival
        part = df.filter((F.col("epoch") >= low) & (F.col("epoch") < low + 10))
        part.orderBy(F.xxhash64("epoch")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = watch(spark, tmp_path, df.schema, rows_per_bucket=60, **settings)
    want = runlog.early_stop(df, "run", "epoch", "value", **settings)
    assert plain(got.collect()) == plain(want.collect())
    assert len(list((tmp_path / "out").iterdir())) == 2  # older tables are removed


def test_late_epochs_are_dropped(spark, tmp_path):
    schema = spark.createDataFrame([], "run long, epoch long, value double").schema
    for rows in ([(1, 5, 1.0)], [(1, 3, 9.0), (1, 6, 0.5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        last = watch(spark, tmp_path, schema).first()
    assert (last.best, last.counter, last.stop_epoch, last.last_epoch) == (1.0, 1, None, 6)


def test_a_batch_that_is_one_run_is_cut(spark, tmp_path):
    log = spark.range(4000).selectExpr("7L AS run", "id AS epoch", "cast(id + id % 7 AS double) AS value")
    for low in (0, 2000):
        log.filter((F.col("epoch") >= low) & (F.col("epoch") < low + 2000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = watch(spark, tmp_path, log.schema, delta=9.0, patience=30, rows_per_bucket=300)
    want = runlog.early_stop(log, "run", "epoch", "value", delta=9.0, patience=30)
    assert plain(got.collect()) == plain(want.collect())
