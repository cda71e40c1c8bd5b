"""Rows that cannot take part are named, not lost."""

from pyspark.sql import functions as F

from irisframe.functions import paths, scoring
from irisframe.operators import class_index, confusion, images, pairing, runlog, splits

NAN = float("nan")


def test_no_row_is_lost_without_a_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 2)).alias("g"))
    parts = splits.holdout(df, "g", "id")
    assert parts.count() == 3000 and parts.filter("split = 'quarantine'").count() == 1000
    folds = splits.stratified_folds(df, "g", "id")
    assert folds.count() == 3000 and folds.filter("fold is null").count() == 1000
    labels = class_index.label_alphabetical(df, "g")
    assert labels.count() == 3000 and labels.filter("label is null").count() == 1000


def test_bad_labels_and_logits_have_a_reason(spark):
    rows = [(0, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [1.0, 2.0]), (-1, [1.0, 2.0]), (1, None), (1, [1.0]), (1, [NAN, 1.0])]
    df = spark.createDataFrame(rows, "label int, logits array<double>")
    reasons = [r.reason for r in scoring.scored_rows(df, num_classes=2).collect()]
    assert reasons == [None, "no label", "label out of range", "label out of range"] + ["unusable logits"] * 3
    good, bad = scoring.score_predictions(df, num_classes=2)
    assert (good.count(), bad.count()) == (1, 6)


def test_short_paths(spark):
    df = spark.createDataFrame([("a/b.png",), ("b.png",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.parent_name(F.col("p"))).collect()] == ["a", None, None]


def test_undeclared_predictions_are_counted(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (1, 1), (0, 2)], "label int, pred int")
    wide = confusion.confusion_wide(confusion.confusion_matrix(df), [0, 1], "other")
    assert {tuple(r) for r in wide.collect()} == {(0, 1, 0, 1), (1, 0, 1, 1), (2, 0, 0, 0)}


def test_images_that_do_not_fit(spark):
    rows = [(1, 1, 2, 1, [1.0, 2.0]), (2, 1, 2, 1, None), (3, 1, 2, 3, [0.0] * 6), (4, 1, 3, 1, [1.0])]
    df = spark.createDataFrame(rows, "id long, height int, width int, channels int, px array<double>")
    steps = [images.normalise([0.5], [0.5], 1.0)]
    assert [r.id for r in images.apply_steps(df, steps, "id", pixels="px").collect()] == [1]
    faults = {r.id: r.reason for r in images.rejected_images(df, steps, pixels="px").collect()}
    assert faults == {2: "no pixels", 3: "wrong channel count", 4: "wrong size"}


def test_nan_never_improves(spark):
    rows = [("a", 1, 0.5), ("a", 2, NAN), ("a", 3, 0.6), ("a", 4, 0.7)]
    rows += [("b", 1, NAN), ("b", 2, 0.9), ("b", 3, 0.8)]
    rows += [(None, 1, 0.1), (None, 2, None), (None, 3, 0.2)]
    df = spark.createDataFrame(rows, "run string, epoch long, value double")
    for delta in (0.0, 0.01):
        got = {r.run: r for r in runlog.early_stop(df, "run", "epoch", "value", delta=delta, patience=2).collect()}
        assert (got["a"].best, got["a"].counter, got["a"].stop_epoch) == (0.7, 0, None)
        assert got["b"].best != got["b"].best and (got["b"].counter, got["b"].stop_epoch) == (2, 3)
        assert (got[None].best, got[None].counter, got[None].stop_epoch) == (0.2, 0, None)
        low = {r.run: r for r in runlog.early_stop(df, "run", "epoch", "value", mode="min", delta=delta, patience=2).collect()}
        assert (low["a"].best, low["a"].counter, low["a"].stop_epoch) == (0.5, 2, 3)
    best = {(r.run, r.epoch): (r.best, r.improved) for r in runlog.best_so_far(df, "run", "epoch", "value").collect()}
    assert best["a", 2] == (0.5, False) and best["a", 4] == (0.7, True) and best["b", 1] == (0.0, False)
    top = {r.run: (r.best, r.best_epoch) for r in runlog.best_epoch(df, "run", "epoch", "value").collect()}
    assert top == {"a": (0.7, 4), "b": (0.9, 2), None: (0.2, 3)}
    rates = {r.run: (r.best, r.cuts) for r in runlog.plateau_rate(df, "run", "epoch", "value").collect()}
    assert rates == {"a": (0.7, 0), "b": (0.9, 0), None: (0.2, 0)}


def test_unpaired_draws_reach_far_positions(spark):
    from irisframe.functions.hashing import hash_int, seeded_hash

    top = spark.range(1000).agg(F.max(hash_int(seeded_hash(1, F.col("id"))))).first()[0]
    assert 1 << 58 < top < 1 << 60
    x = spark.createDataFrame([("x",)], "x_path string")
    y = spark.range(50).select(F.concat(F.lit("y"), "id").alias("y_path"))
    assert pairing.pair_unpaired(x, y).count() == 50


def test_minutes_per_epoch(spark):
    rows = [("a", 1, "2020-01-01 00:00:00"), ("a", 1, "2020-01-01 00:03:00"), ("a", 2, "2020-01-01 01:00:30"), ("a", 2, "2020-01-01 01:01:00")]
    df = spark.createDataFrame(rows, "run string, epoch int, t string").withColumn("ts", F.to_timestamp("t"))
    got = {r.epoch: r.minutes for r in runlog.minutes_per_run(df, ["run", "epoch"], "ts").collect()}
    assert got == {1: 3.0, 2: 0.5}
