"""Writers. Every sink is safe to run again after a failure."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPLITS, SplitSettings
from ..functions.paths import parent_name
from ..operators.ordered import Scan, _starts, _written, prefix_scan
from ..operators.small import checked_broadcast
from ..operators.splits import holdout

#: A task of ``write_sized`` takes files of about this many bytes, and at most about
#: this many files.
TASK_BYTES = 128 << 20
FILES_PER_TASK = 500
#: A row looks for its file in parts of two to this power.
CUT_BITS = 9
#: Bytes that ``read_mounted`` joins to a batch, and the most tasks that list folders.
READ_BYTES = 8 << 20
LISTING_TASKS = 64


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with header, in as many files as it was computed in."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def materialise_split(
    files: DataFrame, path: str, settings: SplitSettings = SPLITS, *, file_bytes: int | None = None, size: str | None = None
) -> None:
    """Write (path, content) files as Parquet partitioned by split and class.

    The split is decided by broadcast cut points, so file content goes from the
    scan straight to the writer without a shuffle, and each task writes a file for
    every split and class it meets. With ``file_bytes`` content moves once, into files
    of about that size, see ``write_sized``. ``size`` names a column with the content's
    length, which is not written: where it was taken before a join, as a source of files
    does, content is not moved through the join to be measured.
    """
    tagged = files.withColumn("class", parent_name(F.col("path")))
    split = holdout(tagged, "class", "path", settings=settings)
    if file_bytes is None:
        write_table(split.drop(size) if size else split, path, ("split", "class"))
    else:
        length = F.col(size) if size else F.length("content")
        write_sized(split, path, ("split", "class"), "path", length, file_bytes, unwritten=[size] if size else [])


def file_numbers(df: DataFrame, group: Sequence[str], key: str, size: Column, file_bytes: int) -> tuple[DataFrame, int]:
    """``df`` with ``file``, the number of each row's file inside its group, and how
    many files there are.

    Files are stretches of the group along ``key``, cut where the running sum of sizes
    passes another equal share, so a file differs from its share by at most one row at
    either end. Only keys and sizes are ordered. What goes to every task is the first
    key of each file, in parts; a row finds its part and then its file by halving. (A row
    takes a copy of what it is joined to, so one list of all files would cost rows times
    files.) Rows of equal keys share a file, null keys are in the first, and a null size
    counts as none.
    """
    slim = df.select(*group, key, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    ran = prefix_scan(slim, group, [key], {"_end": Scan("sum", F.col("_size"))}, totals={"_end": "_total"})
    count = F.greatest(F.lit(1), F.round(F.col("_total") / file_bytes)).cast("long")
    share = F.greatest(F.lit(1), F.ceil(F.col("_total") / count)).cast("long")
    shared = ran.withColumn("_count", count).withColumn("_share", share)
    cut = shared.withColumn("_file", F.expr("least(_count - 1, (_end - _size) div _share)"))
    firsts = cut.groupBy(*group, "_file").agg(F.min(key).alias("_first"))
    cuts = firsts.groupBy(*group).agg(F.sort_array(F.collect_list("_first")).alias("_cuts"))
    named = [f"_g{i}" for i in range(len(group))]
    cuts = checked_broadcast(cuts.select(*[F.col(g).alias(n) for g, n in zip(group, named)], "_cuts"))
    files = cuts.agg(F.sum(F.greatest(F.size("_cuts"), F.lit(1)))).first()[0] or 0
    starts = F.expr(f"sequence(0, size(_cuts) - 1, {1 << CUT_BITS})")
    parts = cuts.filter("size(_cuts) > 0").withColumn("_parts", F.transform(starts, lambda i: F.slice("_cuts", i + 1, 1 << CUT_BITS)))
    tops = checked_broadcast(parts.select(*named, F.transform("_parts", lambda p: p[0]).alias("_tops")))
    parts = checked_broadcast(parts.select(*named, F.posexplode("_parts").alias("_part", "_cuts")))

    def last_upto(firsts: str, bits: int) -> Column:
        def halve(at: Column, step: Column) -> Column:
            there = F.get(F.col(firsts), at + step)
            return F.when(there.isNotNull() & (there <= F.col(key)), at + step).otherwise(at)

        return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), halve)

    same = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, named)])
    found = df.join(tops, same, "left").withColumn("_at", last_upto("_tops", 24 - CUT_BITS)).drop("_tops", *named)
    found = found.join(parts, same & (F.col("_at") == F.col("_part")), "left")
    found = found.withColumn("file", F.col("_at") * (1 << CUT_BITS) + last_upto("_cuts", CUT_BITS))
    return found.drop("_at", "_part", "_cuts", *named), files


def write_sized(
    df: DataFrame, path: str, group: Sequence[str], key: str, size: Column, file_bytes: int, *, unwritten: Sequence[str] = ()
) -> None:
    """Write Parquet partitioned by ``group`` and ``file``, one file of about
    ``file_bytes`` (before compression) in each folder, however many tasks read ``df``.
    Columns ``unwritten`` serve to find the files only.

    A file is written by one task; small files share one, so that tasks grow with the
    bytes and not with the files alone. Where ``path`` is a mounted file system the
    tasks open their files themselves, see ``write_mounted``.
    """
    numbered, files = file_numbers(df, group, key, size, file_bytes)
    numbered = numbered.drop(*unwritten)
    tasks = write_tasks(files, file_bytes, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = numbered.repartition(tasks, *group, "file").sortWithinPartitions(*group, "file", key)
    if mounted(df.sparkSession, path, numbered.drop(*group, "file").schema):
        write_mounted(placed, path, (*group, "file"))
    else:
        write_table(placed, path, (*group, "file"))


#: Column types that Arrow stores in Parquet as Spark does, and Spark's names of codecs.
_PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
_CODECS = {"snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "none": "none", "uncompressed": "none"}
_CODEC = "spark.sql.parquet.compression.codec"
#: What Spark escapes in the name of a partition's folder, and names the folder of no value.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def mounted(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Whether tasks can open files of such columns there: Spark itself must reach the
    folder as a local one, as it does a share that all machines have mounted."""
    local = _folder(spark, path)[0].getScheme() == "file"
    return local and spark.conf.get(_CODEC).lower() in _CODECS and all(type(f.dataType) in _PLAIN for f in schema)


def write_mounted(placed: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """The files that ``write_table`` makes of rows sorted by ``partition_by``, opened by
    the tasks without Hadoop's local file system, which starts three or four processes
    a file (``chmod``) and moves every folder on the driver.

    A file gets its name when it is whole, and is the same if a task runs again. All are
    written beside ``path``, which one rename replaces when every task has ended.
    """
    spark, schema = placed.sparkSession, placed.drop(*partition_by).schema
    fs, folder = _folder(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(folder.getParent(), f".{folder.getName()}-{uuid.uuid4().hex}")
    top, codec = staged.toUri().getPath(), _CODECS[spark.conf.get(_CODEC).lower()]
    # With these, Spark reads the columns back with its own types.
    notes = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": schema.json()}
    # Arrow would store the least and the greatest content twice, a third of a small file.
    bounded = [f.name for f in schema if not isinstance(f.dataType, T.BinaryType)]
    named = placed.select(*[F.col(c).cast("string").alias(f"_p{i}") for i, c in enumerate(partition_by)], *schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, files, last, out = f"part-{task.partitionId():05d}.parquet", 0, None, None
        attempt = f".{name}-{task.taskAttemptId()}"
        if not os.path.isdir(top):
            raise FileNotFoundError(f"{top} is not shared between the driver and this executor")

        def ended() -> None:
            out.close()
            os.replace(f"{at}/{attempt}", f"{at}/{name}")

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(len(partition_by))]
            starts = np.flatnonzero(_starts(keys, last, batch.num_rows)).tolist()
            last = [k[-1:] for k in keys]
            rows = pa.Table.from_batches([batch.select(schema.names)]).replace_schema_metadata(notes)
            if (ahead := starts[0] if starts else batch.num_rows):
                out.write_table(rows.slice(0, ahead))
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                if out is not None:
                    ended()
                at = "/".join([top, *[partition_folder(c, k[start].as_py()) for c, k in zip(partition_by, keys)]])
                os.makedirs(at, exist_ok=True)
                out, files = pq.ParquetWriter(f"{at}/{attempt}", rows.schema, compression=codec, write_statistics=bounded, store_schema=False), files + 1
                out.write_table(rows.slice(start, stop - start))
        if out is not None:
            ended()
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    fs.mkdirs(staged)
    try:
        named.mapInArrow(run, "files long").agg(F.sum("files")).collect()
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(staged, "_SUCCESS")).close()
        fs.delete(folder, True)
        if not fs.rename(staged, folder):
            raise OSError(f"{staged} cannot be renamed to {folder}")
    finally:
        fs.delete(staged, True)


def _folder(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it names it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(folder)


def partition_folder(column: str, value: str | None) -> str:
    """The folder of a partition, named as Spark names it."""
    column, value = (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", v or "") for v in (column, value))
    return f"{column}={value or _NO_VALUE}"


def partition_value(folder: str) -> str | None:
    """What ``partition_folder`` made a folder's name of."""
    value = folder.partition("=")[2]
    return None if value == _NO_VALUE else unquote(value)


def write_tasks(files: int, file_bytes: int, parts: int) -> int:
    """How many tasks write ``files`` files: ``parts``, or more where these would take
    too many bytes or files each; never more than there are files."""
    wanted = max(parts, -(-files * file_bytes // TASK_BYTES), -(-files // FILES_PER_TASK))
    return max(1, min(files, wanted))


def read_sized(spark: SparkSession, path: str, columns: str | None = None, group: Sequence[str] = ("split", "class")) -> DataFrame:
    """What ``write_sized`` wrote, by as many tasks as wrote it. Given the ``columns`` of
    its files, a mounted folder is listed and read by tasks alone, see ``read_mounted``.

    Otherwise Spark lists the folders, in as many tasks as a shuffle has (left alone, it
    starts one for each of up to 10,000), and its driver holds every name. Spark counts a
    file as 4 MB at least and would make a task of a few small ones.
    """
    reader, named = spark.read, (*group, "file")
    if columns is not None:
        schema = T.StructType.fromDDL(columns)
        if mounted(spark, path, schema):
            return read_mounted(spark, path, schema, named).withColumn("file", F.col("file").cast("int"))
        reader = reader.schema(", ".join([columns, *[f"`{g}` string" for g in group], "file int"]))
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, parts = spark.conf.get(setting, None), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(setting, parts)
    try:
        rows = reader.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    found = rows._jdf.queryExecution().analyzed().relation().location()
    files = found.allFiles().size()
    return rows.coalesce(write_tasks(files, -(-found.sizeInBytes() // max(1, files)), parts))


def read_mounted(spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str]) -> DataFrame:
    """What ``write_mounted`` wrote, with the folders' values as strings. Folders are
    listed once, by tasks, and their names stored, so that no machine holds a row for
    every file."""
    parts, top = int(spark.conf.get("spark.sql.shuffle.partitions")), _folder(spark, path)[1].toUri().getPath()
    found = spark.createDataFrame([(top, 0)], "folder string, bytes long")
    for _ in partition_by:
        found = found.repartition(min(parts, LISTING_TASKS), "folder").mapInArrow(_inner_folders, found.schema)
    found = _written(found)
    files, size = found.agg(F.count("folder"), F.sum("bytes")).first()
    dealt = found.repartition(write_tasks(files, -(-(size or 0) // max(1, files)), parts), "folder").select("folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            values = [partition_value(f) for f in folder.split("/")[-len(partition_by) :]]
            for entry in _shown(folder):
                with pq.ParquetFile(entry.path) as file:
                    for i in range(file.num_row_groups):
                        rows = file.read_row_group(i, schema.names)
                        filled = [pa.repeat(pa.scalar(v, pa.string()), rows.num_rows) for v in values]
                        held.append(pa.table([*rows.columns, *filled], [*schema.names, *partition_by]))
                        size += rows.nbytes
                        if size >= READ_BYTES:
                            yield from pa.concat_tables(held).combine_chunks().to_batches()
                            held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return dealt.mapInArrow(run, T.StructType([*schema, *[T.StructField(n, T.StringType()) for n in partition_by]]))


def _inner_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folders inside each, and how many bytes of files lie in them."""
    for folder in (f for b in batches for f in b.column(0).to_pylist()):
        inner = [e.path for e in _shown(folder) if e.is_dir()]
        for start in range(0, len(inner), 10_000):
            some = inner[start : start + 10_000]
            sizes = [sum(e.stat().st_size for e in _shown(f) if e.is_file()) for f in some]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array(sizes, pa.int64())], ["folder", "bytes"])


def _shown(folder: str) -> list[os.DirEntry]:
    """What lies in a folder, without the names that Spark passes over."""
    with os.scandir(folder) as entries:
        return [e for e in entries if e.name[0] != "." and (e.name[0] != "_" or "=" in e.name)]


def write_finished(done: DataFrame, table: str, path: str, key: str, buckets: int, *, more: bool = False) -> DataFrame:
    """Store finished rows as a table bucketed and sorted by ``key``; with ``more``
    add them to what the table holds. Joins on ``key`` then read the table bucket by
    bucket and move only the other side."""
    out = done.write.bucketBy(buckets, key).sortBy(key).mode("append" if more else "overwrite").option("path", path)
    out.saveAsTable(table)
    return done.sparkSession.table(table)
