import hashlib

import pytest
from pyspark.sql import functions as F

from irisframe.config import SplitSettings
from irisframe.operators import pairing, small, splits
from irisframe.sources import sinks


@pytest.fixture(scope="module")
def manifest(spark):
    rows = spark.range(2000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "tiny").otherwise("mid").alias("class"),
    )
    return rows.unionByName(spark.createDataFrame([("only", "single"), ("x", "pair"), ("y", "pair")], "path string, `class` string")).cache()


def sizes(df, *cols):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*cols).count().collect()}


def test_holdout_sizes_are_exact(manifest):
    got = sizes(splits.holdout(manifest, "class", "path"), "class", "split")
    for (name,), n in sizes(manifest, "class").items():
        test = -(-n * 15 // 100)
        val = -(-(n - test) * 20 // 100)
        want = {"test": test, "val": val, "train": n - test - val}
        assert {s: got.get((name, s), 0) for s in want} == want


def test_holdout_ignores_partitioning_and_depends_on_seed(manifest):
    key = lambda df: {r.path: r.split for r in df.collect()}
    base = key(splits.holdout(manifest, "class", "path"))
    assert key(splits.holdout(manifest.repartition(13), "class", "path")) == base
    other = key(splits.holdout(manifest, "class", "path", settings=SplitSettings(seed=7)))
    assert other.keys() == base.keys() and other != base


def test_holdout_without_broadcast(manifest, monkeypatch):
    """More classes than may be broadcast: the same rows through shuffle joins."""
    want = {r.path: r.split for r in splits.holdout(manifest, "class", "path").collect()}
    monkeypatch.setattr(splits, "checked_broadcast", lambda df: small.checked_broadcast(df, 1))
    got = {r.path: r.split for r in splits.holdout(manifest, "class", "path").collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1, 40, 10**6])
def test_ranks_in_small_and_large_prefixes(spark, limit):
    """One class with almost all rows, ranks at both ends, any number of rounds."""
    rows = spark.range(9000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("g"))
    targets = {"low": F.lit(1), "mid": F.floor(F.col("n") / 2), "high": F.col("n"), "none": F.lit(0)}
    got = {r.g: r for r in splits.rank_cuts(rows, "g", "id", targets, seed=3, rows_per_prefix=limit).collect()}
    for g in ("rare", "hot"):
        keys = sorted((hashlib.md5(f"3:{r.id}".encode()).hexdigest(), r.id) for r in rows.filter(F.col("g") == g).collect())
        found = {k: None if got[g][k] is None else tuple(got[g][k]) for k in targets}
        assert found == {"low": keys[0], "mid": keys[len(keys) // 2 - 1], "high": keys[-1], "none": None}


def test_last_prefixes_are_bounded(spark, monkeypatch):
    """However many rows a class has, what is sorted is cut down to the limit."""
    seen = []
    whole = splits._evaluated
    monkeypatch.setattr(splits, "_evaluated", lambda w: seen.append(whole(w)) or seen[-1])
    rows = spark.range(200_000).select("id", F.lit("all").alias("g"))
    splits.rank_cuts(rows, "g", "id", {"cut": F.lit(77_777)}, seed=1, rows_per_prefix=10).count()
    assert [m > 10 for _, m in seen] == [True, False]


def test_holdout_moves_no_rows(manifest):
    plan = splits.holdout(manifest, "class", "path")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_external_validation(manifest):
    valid = manifest.filter("class = 'tiny'")
    train = manifest.filter("class <> 'tiny'")
    got = sizes(splits.holdout_with_external_val(train, valid, "class", "path"), "class", "split")
    assert got[("tiny", "val")] == valid.count()
    assert ("big", "val") not in got and got[("big", "test")] == -(-667 * 15 // 100)


def test_split_counts_have_totals(manifest):
    got = {(r.split, r["class"]): r.n for r in splits.split_counts(splits.holdout(manifest, "class", "path"), "class").collect()}
    assert got[(None, None)] == 2003
    assert got[("test", None)] == sum(v for (s, c), v in got.items() if s == "test" and c)


def test_folds_are_balanced(manifest):
    folded = splits.stratified_folds(manifest, "class", "path")
    assert folded.count() == manifest.count()
    per_class = sizes(folded, "class", "fold")
    for (name,), n in sizes(manifest, "class").items():
        counts = [per_class.get((name, f), 0) for f in range(5)]
        assert max(counts) - min(counts) <= 1
    totals = [n for _, n in sizes(folded, "fold").items()]
    assert max(totals) - min(totals) <= 1
    roles = sizes(splits.fold_roles(folded), "run", "role")
    assert sum(n for (_, role), n in roles.items() if role == "val") == manifest.count()
    train, val = splits.fold_parts(folded, 2)
    assert train.count() + val.count() == manifest.count() and val.count() == roles[(2, "val")]


def test_shuffle_and_batches(manifest):
    first = splits.batched(splits.shuffled(manifest, "path", epoch=0), 64)
    rows = first.collect()
    assert sorted(r.idx for r in rows) == list(range(2003))
    assert sizes(first, "batch_id")[(31,)] == 2003 - 31 * 64
    again = {r.path: r.idx for r in splits.shuffled(manifest.repartition(9), "path", epoch=0).collect()}
    assert again == {r.path: r.idx for r in rows}
    assert again != {r.path: r.idx for r in splits.shuffled(manifest, "path", epoch=1).collect()}
    assert splits.every_nth(first, 100).count() == 21


def test_mix(manifest):
    real, synthetic = manifest.filter("class = 'mid'"), manifest.filter("class <> 'mid'")
    got = sizes(splits.mix_synthetic(real, synthetic, "path", 30), "origin")
    n = real.count()
    assert got == {("real",): n, ("synthetic",): min(n * 30 // 70, synthetic.count())}
    few = synthetic.filter("class = 'tiny'")
    assert sizes(splits.mix_synthetic(real, few, "path", 30), "origin")[("synthetic",)] == few.count()


def test_positional_pairs(spark):
    real = spark.createDataFrame([("c",), ("a",), ("b",)], "real_path string")
    files = ["out/synthetic_OCT_1.png", "out/synthetic_OCT_3.png", "out/notes.txt"]
    synthetic = spark.createDataFrame([(f,) for f in files], "synthetic_path string")
    got = {r.real_path: r.synthetic_path for r in pairing.pair_positional(real, synthetic).collect()}
    assert got == {"a": files[0], "c": files[1]}
    assert [r.real_path for r in pairing.pair_missing(real, synthetic).collect()] == ["b"]


def test_unpaired(spark):
    x = spark.createDataFrame([(f"x{i}",) for i in range(3)], "x_path string")
    y = spark.createDataFrame([(f"y{i}",) for i in range(50)], "y_path string")
    rows = pairing.pair_unpaired(x, y).collect()
    assert sorted(r.i for r in rows) == list(range(50))
    assert all(r.x_path == f"x{r.i % 3}" for r in rows)
    assert len({r.y_path for r in rows}) > 20
    assert {(r.i, r.y_path) for r in rows} != {(r.i, r.y_path) for r in pairing.pair_unpaired(x, y, epoch=1).collect()}
    with pytest.raises(ValueError):
        pairing.pair_unpaired(x.filter("false"), y)


def test_pending_and_skip(spark):
    inputs = spark.range(10).withColumnRenamed("id", "k")
    done = inputs.filter("k % 3 = 0")
    assert sorted(r.k for r in pairing.pending(inputs, done, "k").collect()) == [1, 2, 4, 5, 7, 8]
    assert pairing.skip_until(inputs, "k", 7).count() == 3


def test_bucketed_resume_moves_only_the_inputs(spark, tmp_path):
    rows = spark.range(5000).withColumnRenamed("id", "key")
    done = sinks.write_finished(rows.filter("key % 3 = 0"), "finished_a", str(tmp_path / "f"), "key", 8)
    done = sinks.write_finished(rows.filter("key % 3 = 1"), "finished_a", str(tmp_path / "f"), "key", 8, more=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = pairing.pending(rows, done, "key")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert {r.key for r in left.collect()} == {i for i in range(5000) if i % 3 == 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE finished_a")


def test_files_by_bytes_whatever_the_tasks(spark, tmp_path):
    # One class holds most rows; one row has no class, one no content.
    names = [f"/in/{'big' if i % 10 else 'small'}/{i:05d}.bin" for i in range(3000)]
    rows = [(n, bytes(50 + (i * 37) % 100)) for i, n in enumerate(names)] + [(None, b"x"), ("/in/small/none.bin", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    layouts = []
    for tasks in (1, 7):
        out = str(tmp_path / f"sized{tasks}")
        sinks.materialise_split(files.repartition(tasks), out, file_bytes=10_000)
        back = spark.read.parquet(out).withColumn("name", F.input_file_name())
        sizes = back.groupBy("split", "class", "file").agg(
            F.sum(F.length("content")).alias("bytes"), F.countDistinct("name").alias("names")
        ).collect()
        assert all(r.names == 1 for r in sizes)
        big = [r.bytes for r in sizes if r["class"] == "big"]
        assert len(big) > 20 and max(big) <= 2 * min(big) and 5_000 <= min(big) and max(big) <= 20_000
        layouts.append({(r.path, r.split, r["class"], r.file) for r in back.collect()})
        assert len(layouts[-1]) == len(rows)
    assert layouts[0] == layouts[1]
    empty = str(tmp_path / "empty")
    sinks.materialise_split(files.limit(0), empty, file_bytes=10_000)


def test_small_files_share_a_task(spark, tmp_path):
    # About 200 files, of which each task writes many.
    rows = [(f"/in/{'ab'[i % 2]}/{i:05d}.bin", bytes(100)) for i in range(2000)]
    files = spark.createDataFrame(rows, "path string, content binary")
    out, setting = str(tmp_path / "small"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    sinks.materialise_split(files, out, file_bytes=1_000)
    before = spark.conf.get(setting)
    back = sinks.read_sized(spark, out)
    assert spark.conf.get(setting) == before
    named = back.withColumn("name", F.input_file_name()).groupBy("split", "class", "file").agg(F.countDistinct("name").alias("n"), F.max("name").alias("name"))
    names = named.collect()
    assert len(names) >= 190 and all(r.n == 1 for r in names)
    assert len({r.name.rsplit("part-", 1)[1][:5] for r in names}) <= 8
    assert {(r.path, bytes(r.content)) for r in back.collect()} == set(rows)


def test_write_tasks_follow_bytes_and_files():
    assert sinks.write_tasks(0, 20_000, 12) == 1
    assert sinks.write_tasks(5, 20_000, 12) == 5
    assert sinks.write_tasks(5_000, 20_000, 12) == 12
    assert sinks.write_tasks(50_000, 20_000, 12) == 100
    assert sinks.write_tasks(400, 256 << 20, 12) == 400


def _odd_files(spark, n=600):
    """Files of classes whose names a folder cannot have as they are, one without class, one without content."""
    odd = ["a b", "a=b", "50%", "ü", "x:y", "[z]", "q'", '"', "#", "w^", "{", "007", "~", "back\\slash", "*", "tab\t", "%2F"]
    rows = [(f"/in/{odd[i % len(odd)]}/{i:05d}.bin", bytes(100 + i % 7), i if i % 3 else None, i / 8, bool(i % 2)) for i in range(n)]
    rows += [(None, b"x", 1, None, None), ("/in/a b/none.bin", None, 2, 1.0, None)]
    columns = "path string, content binary, n int, d double, b boolean"
    return spark.createDataFrame(rows, columns), columns, len(rows)


def _folders(top):
    return sorted(str(f.parent.relative_to(top)) for f in top.rglob("part-*.parquet"))


def test_files_of_a_mounted_folder_equal_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    files, columns, n = _odd_files(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sinks.materialise_split(files, str(tmp_path / "near"), file_bytes=1_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with monkeypatch.context() as far:
        far.setattr(sinks, "mounted", lambda *_: False)
        sinks.materialise_split(files, str(tmp_path / "far"), file_bytes=1_000)
        listed = sinks.read_sized(spark, str(tmp_path / "far"), columns)
    assert _folders(tmp_path / "near") == _folders(tmp_path / "far")
    assert len(_folders(tmp_path / "near")) == len(set(_folders(tmp_path / "near"))) > 60
    backs = [spark.read.parquet(str(tmp_path / "far")), listed]
    for name in ("near", "far"):
        backs += [sinks.read_sized(spark, str(tmp_path / name)), sinks.read_sized(spark, str(tmp_path / name), columns)]
    rows = sorted(map(repr, backs[0].collect()))
    assert len(rows) == n
    for back in backs[1:]:
        assert back.dtypes == backs[0].dtypes and sorted(map(repr, back.collect())) == rows


def test_a_mounted_folder_has_its_files_alone(spark, tmp_path):
    # Hadoop's local file system adds a checksum file to each, and starts processes for both.
    files, columns, _ = _odd_files(spark, 300)
    out = tmp_path / "out"
    sinks.materialise_split(files, str(out), file_bytes=1_000)
    assert [f for f in out.rglob(".*") if f.name != "._SUCCESS.crc"] == []
    sinks.materialise_split(files.limit(3), str(out), file_bytes=1_000)
    assert sinks.read_sized(spark, str(out), columns).count() == 3
    # A write that fails leaves what was there, and nothing beside it.
    broken = files.withColumn("content", F.expr("if(n = 299, raise_error('unreadable'), content)"))
    held = _folders(out)
    with pytest.raises(Exception, match="unreadable"):
        sinks.write_mounted(broken.selectExpr("path", "content", "'x' AS class"), str(out), ("class",))
    assert _folders(out) == held and [f.name for f in tmp_path.iterdir()] == ["out"]
    sinks.materialise_split(files.limit(0), str(out), file_bytes=1_000)
    assert sinks.read_sized(spark, str(out), columns).count() == 0


def test_mounted_files_hold_their_content_once(spark, tmp_path):
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(20)])
    files = spark.range(300).select(F.format_string("/in/a/%05d", "id").alias("path"), F.unhex(text).alias("content"))
    sinks.materialise_split(files, str(tmp_path / "out"), file_bytes=6_400)
    written = [f.stat().st_size for f in (tmp_path / "out").rglob("part-*")]
    assert len(written) > 50 and sum(written) < 1.25 * 300 * 1_280
    assert spark.read.parquet(str(tmp_path / "out")).filter("path = '/in/a/00007'").count() == 1


def test_other_columns_and_other_stores_go_through_spark(spark, tmp_path):
    files = spark.range(400).selectExpr("concat('/in/a/', id) AS path", "cast(repeat('x', 100) AS binary) AS content", "timestamp_seconds(id) AS at")
    sinks.materialise_split(files, str(tmp_path / "at"), file_bytes=1_000)
    back = sinks.read_sized(spark, str(tmp_path / "at"), "path string, content binary, at timestamp")
    assert {(r.path, r.at) for r in back.collect()} == {(r.path, r.at) for r in files.collect()}
    assert back.select("file").distinct().count() > 20
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    try:
        sinks.materialise_split(files.drop("at"), "viewfs://box/in/far", file_bytes=1_000)
        assert sinks.read_sized(spark, "viewfs://box/in/far", "path string, content binary").count() == 400
    finally:
        conf.unset("fs.viewfs.mounttable.box.link./in")


def test_small_files_share_a_task_that_reads_them(spark, tmp_path):
    files, columns, n = _odd_files(spark)
    out = str(tmp_path / "out")
    sinks.materialise_split(files, out, file_bytes=1_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        for back in (sinks.read_sized(spark, out), sinks.read_sized(spark, out, columns)):
            assert back.rdd.getNumPartitions() <= 8 and back.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_are_found_in_parts_of_the_list(spark, monkeypatch):
    # About 90 files in one group, the others small; keys that repeat, null keys and a group of these alone.
    rows = [("big", f"{i * 7 % 900:04d}", 10) for i in range(900)] + [("big", "0500", 10), ("big", None, 5), ("small", "a", 1), ("small", "b", None)]
    rows += [(None, "0001", 3), ("keyless", None, 30)]
    df = spark.createDataFrame(rows, "g string, k string, size int")
    found = {}
    for bits in (1, 3, 9):
        monkeypatch.setattr(sinks, "CUT_BITS", bits)
        numbered, files = sinks.file_numbers(df, ["g"], "k", F.col("size"), 100)
        assert numbered.columns == ["g", "k", "size", "file"]
        found[bits] = files, sorted(map(repr, numbered.collect()))
    assert found[1] == found[3] == found[9] and len(found[9][1]) == len(rows)
    start, total, cuts = 0, 9_015, {}
    for k, size in [(None, 5)] + sorted((r[1], r[2]) for r in rows if r[0] == "big" and r[1]):
        cuts.setdefault(k, min(89, start // -(-total // 90)))
        start += size
    numbers = {c: n for n, c in enumerate(sorted(set(cuts.values())))}
    got = {r.k: r.file for r in numbered.filter("g = 'big'").collect()}
    assert got == {k: numbers[c] for k, c in cuts.items()}
    assert {(r.g, r.file) for r in numbered.filter("g IS NULL OR g <> 'big'").collect()} == {("small", 0), (None, 0), ("keyless", 0)}


def test_a_known_length_is_used_and_not_written(spark, tmp_path):
    files, columns, n = _odd_files(spark, 300)
    known = files.join(files.select("path", F.length("content").alias("length")), "path")
    sinks.materialise_split(known, str(tmp_path / "known"), file_bytes=1_000, size="length")
    sinks.materialise_split(files.filter("path IS NOT NULL"), str(tmp_path / "measured"), file_bytes=1_000)
    known, measured = (sinks.read_sized(spark, str(tmp_path / name)) for name in ("known", "measured"))
    assert known.dtypes == measured.dtypes and known.count() == n - 1
    assert sorted(map(repr, known.collect())) == sorted(map(repr, measured.collect()))
    sinks.materialise_split(files.withColumn("length", F.lit(1)), str(tmp_path / "plain"), size="length")
    assert "length" not in spark.read.parquet(str(tmp_path / "plain")).columns
