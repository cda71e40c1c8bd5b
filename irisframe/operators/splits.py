"""Exact holdouts, stratified folds, shuffles, batches and mixes of a manifest.

Every choice follows the order of a seeded hash of the row id, so it is the same
for any partitioning, and sizes are exact (unlike ``randomSplit``/``sampleBy``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SPLITS, SplitSettings
from ..functions.hashing import hash_prefix, seeded_hash
from .ordered import global_index
from .small import checked_broadcast


ROWS_PER_PREFIX = 100_000
#: Hex digits that a round of the radix selection adds, and those of a hash.
DIGITS = 3
HASH_DIGITS = 32


def ceil_percent(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100) in integers."""
    return F.floor((n * percent + 99) / 100).cast("long")


def prefix_digits(df: DataFrame) -> int:
    """Hex digits that cut the rows' hashes into buckets of a bounded size."""
    rows, digits = df.count(), 1
    while rows > ROWS_PER_PREFIX * 16**digits:
        digits += 1
    return digits


def rank_cuts(
    df: DataFrame,
    group: str,
    row_id: str,
    targets: Mapping[str, Column],
    *,
    seed: int,
    rows_per_prefix: int = ROWS_PER_PREFIX,
) -> DataFrame:
    """Per group, the (hash, id) key of the row at each target rank.

    ``targets`` maps a name to a rank computed from column ``n``, the group's
    size. A rank of 0 gives null. This is a radix selection: counts per (group,
    hash prefix) tell which prefix holds a rank, and as long as such a prefix has
    more than ``rows_per_prefix`` rows it is counted again by longer prefixes.
    Only the rows of the last prefixes are sorted, and no other row is shuffled.
    """
    slim = df.select(F.col(group).alias("_g"), F.col(row_id).alias("_id"))
    slim = slim.withColumn("_h", seeded_hash(seed, F.col("_id")))
    digits = DIGITS
    ranks = F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), r.cast("long").alias("_at")) for k, r in targets.items()]))
    first = _counted(slim.withColumn("_p", F.lit("")), digits).withColumn("n", F.sum("_c").over(W.partitionBy("_g")))
    wanted, most = _evaluated(_holding(first.select("_g", "_b", "_end", "_c", ranks)))
    while most > rows_per_prefix and digits < HASH_DIGITS:
        held = slim.withColumn("_p", hash_prefix(F.col("_h"), digits)).join(wanted.select("_g", "_p").distinct(), ["_g", "_p"], "left_semi")
        digits += DIGITS
        inside = wanted.select("_g", "_p", "_k", "_at").join(_counted(held, digits), ["_g", "_p"])
        wanted, most = _evaluated(_holding(inside))
    keyed = slim.withColumn("_p", hash_prefix(F.col("_h"), digits)).join(wanted.select("_g", "_p").distinct(), ["_g", "_p"], "left_semi")
    placed = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("_g", "_p").orderBy("_h", "_id")))
    hits = placed.join(wanted, ["_g", "_p"]).filter(F.col("_rank") == F.col("_at"))
    key = F.struct("_h", "_id")
    cuts = hits.groupBy("_g").agg(*[F.first(F.when(F.col("_k") == k, key), ignorenulls=True).alias(k) for k in targets])
    return cuts.withColumnRenamed("_g", group)


def _counted(rows: DataFrame, digits: int) -> DataFrame:
    """Rows per (group, prefix, longer prefix), and up to which rank they reach."""
    upto = W.partitionBy("_g", "_p").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    counts = rows.groupBy("_g", "_p", hash_prefix(F.col("_h"), digits).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.withColumn("_end", F.sum("_c").over(upto))


def _holding(ranks: DataFrame) -> DataFrame:
    """The prefix that holds each wanted rank, and the rank inside it."""
    before = F.col("_end") - F.col("_c")
    found = ranks.filter((F.col("_at") > before) & (F.col("_at") <= F.col("_end")))
    return found.select("_g", F.col("_b").alias("_p"), "_k", (F.col("_at") - before).alias("_at"), "_c")


def _evaluated(wanted: DataFrame) -> tuple[DataFrame, int]:
    """``wanted``, broadcast if it is small, and the most rows that a prefix has."""
    local = checked_broadcast(wanted)
    return local, local.agg(F.max("_c")).first()[0] or 0


def _below(cut: str, row_id: str, seed: int) -> Column:
    key = F.struct(seeded_hash(seed, F.col(row_id)).alias("_h"), F.col(row_id).alias("_id"))
    return F.coalesce(key <= F.col(cut), F.lit(False))


def holdout(
    df: DataFrame,
    group: str,
    row_id: str,
    *,
    settings: SplitSettings = SPLITS,
    with_val: bool = True,
) -> DataFrame:
    """Add ``split`` (test/val/train), exact per class.

    test = ceil(15 % of the class), val = ceil(20 % of the rest). Rows without a
    class get the split "quarantine". The input rows themselves never move, so
    image content can ride along.
    """
    n = F.col("n")
    test = ceil_percent(n, settings.test_percent)
    targets = {"_test_cut": test}
    if with_val:
        targets["_val_cut"] = test + ceil_percent(n - test, settings.val_percent)
    known = df.filter(F.col(group).isNotNull())
    cuts = checked_broadcast(rank_cuts(known, group, row_id, targets, seed=settings.seed))
    split = F.when(F.col(group).isNull(), "quarantine").when(_below("_test_cut", row_id, settings.seed), "test")
    if with_val:
        split = split.when(_below("_val_cut", row_id, settings.seed), "val")
    return df.join(cuts, group, "left").withColumn("split", split.otherwise("train")).drop(*targets)


def holdout_with_external_val(
    train: DataFrame,
    valid: DataFrame,
    group: str,
    row_id: str,
    *,
    settings: SplitSettings = SPLITS,
) -> DataFrame:
    """Train/test from one folder; another folder is the validation set whole."""
    parts = holdout(train, group, row_id, settings=settings, with_val=False)
    return parts.unionByName(valid.withColumn("split", F.lit("val")))


def split_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows per split and class, with subtotals (null = all)."""
    # Count first: the cube then expands a handful of rows, not the table.
    counts = df.groupBy("split", group).agg(F.count(F.lit(1)).alias("c"))
    return counts.cube("split", group).agg(F.sum("c").alias("n"))


def stratified_folds(
    df: DataFrame, group: str, row_id: str, *, settings: SplitSettings = SPLITS
) -> DataFrame:
    """Add ``fold``: position in (class, hash) order modulo k.

    Class counts per fold and fold totals each differ by at most one. Rows without
    a class get a null fold.
    """
    keyed = df.withColumn("_h", seeded_hash(settings.seed, F.col(row_id)))
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    # One row per class, so a single ordered window is enough.
    earlier = W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    placed = global_index(
        keyed, ["_h", row_id], group=[group], bucket=hash_prefix(F.col("_h"), prefix_digits(df)), name="_i"
    )
    fold = ((F.col("_off") + F.col("_i")) % settings.folds).cast("int")
    return placed.join(checked_broadcast(offsets), group, "left").withColumn("fold", fold).drop("_h", "_i", "_off")


def fold_roles(df: DataFrame, folds: int = SPLITS.folds) -> DataFrame:
    """One row per (row, run): ``role`` is val in the run of its own fold, else train."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    role = F.when(F.col("run") == F.col("fold"), "val").otherwise("train")
    return df.withColumn("run", runs).withColumn("role", role)


def fold_parts(df: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) rows of one run, as plain filters."""
    return df.filter(F.col("fold") != run), df.filter(F.col("fold") == run)


def shuffled(df: DataFrame, row_id: str, *, seed: int = SPLITS.seed, epoch: int = 0) -> DataFrame:
    """Add ``idx``, the row's position in that epoch's seeded shuffle."""
    keyed = df.withColumn("_h", seeded_hash(seed, epoch, F.col(row_id)))
    bucket = hash_prefix(F.col("_h"), prefix_digits(df))
    return global_index(keyed, ["_h", row_id], bucket=bucket).drop("_h")


def batched(df: DataFrame, batch_size: int, index: str = "idx") -> DataFrame:
    """Add ``batch_id``; the last batch may be short."""
    return df.withColumn("batch_id", F.floor(F.col(index) / batch_size).cast("long"))


def every_nth(df: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """Rows at positions 0, n, 2n, ...: the progress marks of a long job."""
    return df.filter(F.col(index) % n == 0)


def mix_synthetic(
    real: DataFrame,
    synthetic: DataFrame,
    row_id: str,
    percent: int = 30,
    *,
    seed: int = SPLITS.seed,
) -> DataFrame:
    """Real rows plus the first m synthetic rows in hash order, so that synthetic
    rows make up ``percent`` of the result (m is rounded down; all of them when
    there are fewer)."""
    wanted = real.count() * percent // (100 - percent)
    pool = synthetic.withColumn("_all", F.lit(1))
    rank = F.least(F.lit(wanted).cast("long"), F.col("n"))
    cuts = checked_broadcast(rank_cuts(pool, "_all", row_id, {"_cut": rank}, seed=seed))
    chosen = pool.join(cuts, "_all").filter(_below("_cut", row_id, seed)).drop("_all", "_cut")
    return real.withColumn("origin", F.lit("real")).unionByName(
        chosen.withColumn("origin", F.lit("synthetic"))
    )
