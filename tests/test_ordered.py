"""Bucketed scans give the plain window's result for skewed and odd keys."""

import random

import pytest
from pyspark.sql import functions as F

from irisframe.operators.ordered import Scan, _scan_ranges, global_index, prefix_scan, range_cut
from irisframe.operators.small import checked_broadcast


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.uniform(-5, 5)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, o long, v double").repartition(5).cache()


def test_bucketed_scan_equals_window(skewed):
    scans = {
        "total": Scan("sum", F.col("v")),
        "before": Scan("max", F.col("v"), inclusive=False),
        "low": Scan("min", F.col("v")),
        "earlier": Scan("sum", F.lit(1), inclusive=False),
    }
    plain = {(r.g, r.o): r for r in prefix_scan(skewed, ["g"], ["o"], scans, F.lit(0)).collect()}
    cut = {(r.g, r.o): r for r in prefix_scan(skewed, ["g"], ["o"], scans, rows_per_bucket=100).collect()}
    assert plain.keys() == cut.keys()
    for key, p in plain.items():
        c = cut[key]
        assert c.total == pytest.approx(p.total)
        assert (c.before, c.low, c.earlier) == (p.before, p.low, p.earlier)


def test_hot_group_is_spread_over_buckets(skewed):
    sizes = range_cut(skewed, ["g", "o"], rows_per_bucket=100).groupBy("g", F.col("_bucket").alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 400
    assert sizes.filter("g = 'hot'").count() > 5


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_global_index_is_dense_and_stable(skewed, parts):
    got = global_index(skewed.repartition(parts), ["o"], rows_per_bucket=200).select("o", "idx").collect()
    assert sorted((r.o, r.idx) for r in got) == [(i, i) for i in range(3000)]


def test_string_order_is_binary(spark):
    names = ["a/10", "a/9", "B/1", "é", "z", "a/1", "~"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r.idx for r in global_index(df, ["p"], rows_per_bucket=2).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(names)


def test_nulls_are_a_group_and_order_first(spark):
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i) for i in range(900)] + [(None, None), ("k0", None)]
    df = spark.createDataFrame(rows, "g string, o long")
    for size in (20, 10**6):
        got = global_index(df, ["o"], group=["g"], rows_per_bucket=size).collect()
        assert len(got) == len(rows)
        for g in (None, "k0", "k1"):
            own = sorted((r.idx, -1 if r.o is None else r.o) for r in got if r.g == g)
            assert own == list(enumerate(sorted(o for _, o in own)))


def test_many_large_groups_are_cut(spark):
    df = spark.range(12_000).select((F.col("id") % 60).alias("g"), F.col("id").alias("o"))
    cut = range_cut(df, ["g", "o"], rows_per_bucket=10)
    assert cut.groupBy("g", "_bucket").count().agg(F.max("count")).first()[0] < 60
    got = global_index(df, ["o"], group=["g"], rows_per_bucket=10)
    assert got.filter(F.col("idx") != F.floor(F.col("o") / 60)).count() == 0


def test_totals_come_with_the_scan(skewed):
    got = prefix_scan(skewed, ["g"], ["o"], {"n": Scan("sum", F.lit(1))}, rows_per_bucket=100, totals={"n": "all"})
    sizes = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    assert all(r["all"] == sizes[r.g] for r in got.collect())


def test_checked_broadcast_falls_back(spark):
    df = spark.range(10)
    small = checked_broadcast(df, 10)
    assert "LocalTableScan" in small._jdf.queryExecution().toString() or small.count() == 10
    assert checked_broadcast(df, 9) is df
    assert checked_broadcast(df.filter("id < 0"), 9).count() == 0


def test_alphabetical_labels_for_many_classes(spark, monkeypatch):
    from irisframe.operators import class_index

    df = spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 100).alias("class"))
    small = {r["class"]: r.label for r in class_index.label_alphabetical(df).distinct().collect()}
    monkeypatch.setattr(class_index, "evaluated_if_small", lambda d: None)
    large = {r["class"]: r.label for r in class_index.label_alphabetical(df).distinct().collect()}
    assert small == large == {c: i for i, c in enumerate(sorted(f"c{i}" for i in range(100)))}


def test_scan_of_nulls_and_nan_equals_windows(spark):
    """Groups and values of every kind, over several ranges, as Spark's windows have them."""
    rng = random.Random(8)
    nan = float("nan")
    odd = [None, nan, -0.0, 0.0, 1.5, -7.25, float("inf")]
    rows = [(rng.choice([None, nan, 0.0, -0.0, 2.0]), i, rng.choice(odd), rng.choice([None, 3, -4, 2**40])) for i in range(600)]
    df = spark.createDataFrame(rows, "g double, o long, v double, k long")
    scans = {f"{kind}_{c}_{i}": Scan(kind, F.col(c), inclusive=bool(i)) for kind in ("sum", "max", "min") for c in ("v", "k") for i in (0, 1)}
    shown = lambda out: {r.o: [repr(r[n]).replace("-0.0", "0.0") for n in scans] for r in out.collect()}
    plain = shown(prefix_scan(df, ["g"], ["o"], scans, F.lit(0)))
    for size in (40, 10**6):
        cut = prefix_scan(df, ["g"], ["o"], scans, rows_per_bucket=size)
        assert shown(cut) == plain
        assert dict(cut.dtypes)["sum_k_1"] == "bigint" and dict(cut.dtypes)["max_v_0"] == "double"


def test_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, o long")
    assert global_index(df, ["o"], group=["g"]).collect() == []


def test_small_buckets_need_no_task_each(spark):
    """Ranges follow the rows a task can take; buckets of any size are cut inside them."""
    df = spark.range(4_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    scans = {"n": Scan("sum", F.lit(1))}
    for stored in (_scan_ranges(df, ["g"], ["o"], scans, 10).filter("_edge IS NULL"), range_cut(df, ["g", "o"], rows_per_bucket=10)):
        assert stored.select(F.input_file_name()).distinct().count() <= 8
        ends = [F.count("*").alias("rows"), F.min(F.struct("g", "o")).alias("low"), F.max(F.struct("g", "o")).alias("high")]
        buckets = stored.groupBy("_bucket").agg(*ends).orderBy("_bucket").collect()
        assert len(buckets) >= 400 and max(b.rows for b in buckets) == 10
        assert all(tuple(a.high) < tuple(b.low) for a, b in zip(buckets, buckets[1:]))
    ran = prefix_scan(df, ["g"], ["o"], scans, rows_per_bucket=10)
    assert ran.filter(F.col("n") != F.floor(F.col("o") / 3) + 1).count() == 0
