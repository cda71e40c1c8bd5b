"""Joining two image sets by position, at random, and against finished work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPLITS
from ..functions.hashing import hash_int, seeded_hash
from ..functions.paths import synthetic_number
from .ordered import ROWS_PER_BUCKET, global_index
from .small import checked_broadcast


def with_position(
    df: DataFrame, path: str, *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``idx``, the zero-based position in path order."""
    return global_index(df, [path], rows_per_bucket=rows_per_bucket)


def _numbered(synthetic: DataFrame, domain: str, path: str) -> DataFrame:
    number = synthetic_number(F.col(path), domain)
    return synthetic.withColumn("_number", number).filter(F.col("_number").isNotNull())


def pair_positional(
    real: DataFrame,
    synthetic: DataFrame,
    *,
    domain: str = "OCT",
    real_path: str = "real_path",
    synthetic_path: str = "synthetic_path",
) -> DataFrame:
    """Row i of the sorted real set with synthetic file number i + 1."""
    left = with_position(real, real_path).withColumn("_number", F.col("idx") + 1)
    return left.join(_numbered(synthetic, domain, synthetic_path), "_number").drop("_number")


def pair_missing(
    real: DataFrame,
    synthetic: DataFrame,
    *,
    domain: str = "OCT",
    real_path: str = "real_path",
    synthetic_path: str = "synthetic_path",
) -> DataFrame:
    """Real rows whose synthetic partner does not exist."""
    left = with_position(real, real_path).withColumn("_number", F.col("idx") + 1)
    have = _numbered(synthetic, domain, synthetic_path).select("_number")
    return left.join(have, "_number", "left_anti").drop("_number")


def pair_by_lineage(real: DataFrame, synthetic: DataFrame, source_key: str) -> DataFrame:
    """Pair on a recorded source key instead of relying on file positions."""
    return real.join(synthetic, source_key)


def pair_unpaired(
    x: DataFrame,
    y: DataFrame,
    *,
    x_path: str = "x_path",
    y_path: str = "y_path",
    seed: int = SPLITS.seed,
    epoch: int = 0,
) -> DataFrame:
    """One epoch over two unpaired sets, max(|X|, |Y|) rows.

    Row i takes X at i mod |X| and a Y drawn uniformly with replacement. Both
    joins are equi-joins on evenly used positions.
    """
    nx, ny = x.count(), y.count()
    if nx == 0 or ny == 0:
        raise ValueError("both image sets need at least one row")
    rows = x.sparkSession.range(max(nx, ny)).select(
        F.col("id").alias("i"),
        (F.col("id") % nx).alias("_xi"),
        (hash_int(seeded_hash(seed, epoch, F.col("id"))) % ny).alias("_yi"),
    )
    xs = with_position(x.select(x_path), x_path).withColumnRenamed("idx", "_xi")
    ys = with_position(y.select(y_path), y_path).withColumnRenamed("idx", "_yi")
    # Few positions on a side would draw all rows to them: it is broadcast if small.
    return rows.join(checked_broadcast(xs), "_xi").join(checked_broadcast(ys), "_yi").select("i", x_path, y_path)


def self_pair(df: DataFrame, column: str) -> DataFrame:
    """Feed the same image to both streams: a projection, no join."""
    return df.withColumns({"real": F.col(column), "synthetic": F.col(column)}).drop(column)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet; exact for any order of earlier work. A ``done``
    that is bucketed by ``key`` (``sinks.write_finished``) is joined where it lies."""
    return inputs.join(done.select(key), key, "left_anti")


def skip_until(df: DataFrame, index: str, start: int) -> DataFrame:
    """Resume by position for jobs that only remember a start index."""
    return df.filter(F.col(index) >= start)
