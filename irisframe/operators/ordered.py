"""Running values and positions over an order too long for one task.

A plain window over (group, order) sends a whole group through one task. Here
the rows are cut into buckets that follow the order: either a fixed function of
the row's own key, or ranges that Spark draws when it sorts the table.

Ranges are scanned while they are written: the task that holds a sorted range runs
through it batch by batch with the state of the current group, and adds the totals
of its last group. Only the first group of a range can have begun in an earlier
one, so what is carried over is one row for each range, and the result needs no
further shuffle. A range is one task's work and is cut into buckets where it stands, so
small buckets cost no task of their own. Buckets by a function of the key are scanned by windows over
(group, bucket), and bucket totals are prefix-scanned (groups + buckets rows).

Ranges are written to the shared scratch folder once, so that every later use
sees the same buckets, also after an executor is lost. Nulls order first and a
null group is a group like any other, whatever the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

ROWS_PER_BUCKET = 2_000_000
#: Rows that one task sorts and scans, whatever the size of the buckets cut from them.
ROWS_PER_RANGE = 2_000_000
#: Bits that ``monotonically_increasing_id`` leaves to the row inside a partition.
_ROW_BITS = 33


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, max or min of ``value``.

    ``inclusive`` says whether a row sees itself. The order must be unique
    within a group.
    """

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, value: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value)

    def combine(self, a: Column, b: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(a + b, a, b)
        return (F.greatest if self.kind == "max" else F.least)(a, b)


def range_cut(df: DataFrame, keys: Sequence[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with ``_bucket``, a number that never falls along ``keys``.

    A bucket has at most ``rows_per_bucket`` rows, and their number has no ceiling.
    All columns of ``df`` move once and are stored, so it should be slim: keys and
    values, with wide payload joined to the result by key.
    """
    ranged = df.repartitionByRange(_ranges(df), *keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return _written(placed.withColumn("_bucket", F.col("_place") - row % rows_per_bucket).drop("_place"))


def _ranges(df: DataFrame) -> int:
    """Number of ranges: the session's shuffle partitions, or more if these would
    hold more than ``ROWS_PER_RANGE`` rows each. Rows are counted only where the
    optimizer's estimate of the table's bytes, at least eight a row, leaves that open."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate <= 8 * parts * ROWS_PER_RANGE:
        return parts
    return max(parts, -(-df.count() // ROWS_PER_RANGE))


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "ordered")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Types that Arrow compares and numpy scans; others are scanned by windows.
_GROUPS = (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_VALUES = (T.IntegralType, T.FloatType, T.DoubleType)


def _starts(columns: Sequence[pa.Array], before: Sequence[pa.Array] | None, size: int) -> np.ndarray:
    """Whether each row begins a group, given the group of the row before the batch."""
    new = np.zeros(size, dtype=bool)
    new[0] = before is None
    for i, column in enumerate(columns):
        column = pa.concat_arrays([before[i] if before else column[:1], column])
        a, b = column[:-1], column[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        new |= np.asarray(pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))))
    return new


class _Running:
    """One running value over the batches of a range, and its state between them."""

    def __init__(self, kind: str, inclusive: bool):
        self.kind, self.inclusive = kind, inclusive
        self.value, self.seen = None, 0

    def _over(self, a: np.ndarray, b) -> np.ndarray:
        return {"sum": np.add, "max": np.maximum, "min": np.fmin}[self.kind](a, b)

    def __call__(self, column: pa.Array, new: np.ndarray, part: np.ndarray) -> pa.Array:
        valid = np.asarray(column.is_valid())
        if pa.types.is_floating(column.type):
            empty = {"sum": 0.0, "max": -np.inf, "min": np.inf}[self.kind]
        else:
            empty = {"sum": 0, "max": np.iinfo(np.int64).min, "min": np.iinfo(np.int64).max}[self.kind]
        raw = np.asarray(pc.fill_null(column, empty))
        unsound = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(len(raw), dtype=bool)
        grouped = pd.Series(np.where(unsound, empty, raw)).groupby(part, sort=False)
        out = getattr(grouped, {"sum": "cumsum", "max": "cummax", "min": "cummin"}[self.kind])().to_numpy()
        seen = pd.Series(valid.astype(np.int64)).groupby(part, sort=False).cumsum().to_numpy()
        if unsound.any():
            # NaN is the largest value, and makes every sum NaN.
            hits = pd.Series((unsound if self.kind != "min" else valid & ~unsound).astype(np.int64)).groupby(part, sort=False).cumsum().to_numpy()
            out = np.where(hits > 0, np.nan, out) if self.kind != "min" else np.where((seen > 0) & (hits == 0), np.nan, out)
        go_on = part == 0
        if self.seen and go_on.any():
            out[go_on] = np.where(seen[go_on] > 0, self._over(out[go_on], self.value), self.value)
            seen[go_on] += self.seen
        if self.inclusive:
            shown, known = out, seen > 0
        else:
            shown = np.concatenate((out[:1] if self.value is None else [self.value], out[:-1])).astype(out.dtype)
            known = np.concatenate(([self.seen > 0], seen[:-1] > 0)) & ~new
        self.value, self.seen = out[-1], int(seen[-1])
        return pa.array(shown, column.type, mask=~known)

    def total(self, kind: pa.DataType) -> pa.Array:
        return pa.array([self.value if self.seen else None], kind)


def _scan_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], scans: Mapping[str, Scan], rows_per_bucket: int) -> DataFrame:
    """The rows with ``_range`` and ``_bucket``, their running values inside the range
    and whether they are of its first group; and, marked by ``_edge``, a row for the
    first and the last group of every range, whose values are the group's totals there."""
    kept = df.columns
    taken = df.withColumns({f"_v_{n}": s.value for n, s in scans.items()})
    sorted_rows = taken.repartitionByRange(_ranges(df), *group, *order).sortWithinPartitions(*group, *order)
    kinds = {n: _scanned_type(taken.schema[f"_v_{n}"].dataType) for n in scans}
    rules = {n: (s.kind, s.inclusive) for n, s in scans.items()}
    marked = ("_range", "_bucket", "_head", "_edge")
    slim = sorted_rows.select(*kept, *[F.col(f"_v_{n}").cast(kinds[n]).alias(f"_v_{n}") for n in scans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_range, running = TaskContext.get().partitionId(), {n: _Running(*r) for n, r in rules.items()}
        first = last = None
        groups, rows, types = 0, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(g) for g in group]
            new = _starts(columns, last, batch.num_rows)
            part = np.cumsum(new)
            made = {n: r(batch.column(f"_v_{n}"), new, part) for n, r in running.items()}
            head = groups + part <= 1
            groups += int(part[-1])
            first, last = first or [c[:1] for c in columns], [c[-1:] for c in columns]
            types = {n: batch.column(n).type for n in kept} | {n: a.type for n, a in made.items()}
            size = batch.num_rows
            row = np.arange(rows, rows + size)
            rows += size
            bucket = (at_range << _ROW_BITS) + row - row % rows_per_bucket
            marks = [pa.array(np.full(size, at_range, dtype=np.int32)), pa.array(bucket), pa.array(head), pa.nulls(size, pa.bool_())]
            yield pa.record_batch([*[batch.column(n) for n in kept], *made.values(), *marks], [*kept, *made, *marked])
        if not groups:
            return
        # Only totals of the last group are ever carried on; a first group that ends
        # here has none to give, but takes what is carried in.
        for at, is_first, totals in ((first, True, groups == 1), (last, False, True)):
            if is_first or groups > 1:
                named = dict(zip(group, at))
                values = [named.get(n, pa.nulls(1, types[n])) for n in kept]
                values += [r.total(types[n]) if totals else pa.nulls(1, types[n]) for n, r in running.items()]
                marks = [pa.array([at_range], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([is_first])]
                yield pa.record_batch([*values, *marks], [*kept, *running, *marked])

    fields = [T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField(n, kinds[n]) for n in scans]
    marks = [T.StructField(n, k) for n, k in zip(marked, (T.IntegerType(), T.LongType(), T.BooleanType(), T.BooleanType()))]
    return _written(slim.mapInArrow(run, T.StructType(fields + marks)))


def _scanned_type(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def _carried_on(ranges: DataFrame, group: Sequence[str], scans: Mapping[str, Scan]) -> DataFrame:
    """Running values over ranges from their own and what earlier ranges hold of
    their first group."""
    key = F.struct(*[F.col(g) for g in group]) if group else F.lit(0)
    earlier = W.partitionBy("_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    edges = ranges.filter("_edge IS NOT NULL").withColumn("_group", key)
    carried = edges.select("_range", "_edge", *[s.over(F.col(n)).over(earlier).alias(f"_c_{n}") for n, s in scans.items()])
    # One row for each range.
    carried = F.broadcast(carried.filter("_edge").drop("_edge"))
    rows = ranges.filter("_edge IS NULL").join(carried, "_range", "left")
    both = {n: F.when(F.col("_head"), s.combine(F.col(n), F.col(f"_c_{n}"))).otherwise(F.col(n)) for n, s in scans.items()}
    return rows.withColumns(both).drop("_range", "_head", "_edge", *[f"_c_{n}" for n in scans])


def prefix_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    scans: Mapping[str, Scan],
    bucket: Column | None = None,
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    keep_bucket: bool = False,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running values over ``order`` within ``group``.

    ``bucket`` must not decrease along the order inside a group; without it the
    rows are cut into ranges. ``keep_bucket`` leaves it in the result as
    ``_bucket``; passed back in as ``F.col("_bucket")``, a further scan reuses
    it. ``totals`` names columns for the whole group's value of some scans.
    """
    types = df.select(*group, *[s.value.alias(f"_v_{n}") for n, s in scans.items()]).schema if bucket is None else None
    fit = types and all(isinstance(f.dataType, _VALUES if f.name.startswith("_v_") else _GROUPS) for f in types)
    if fit and all(scans[n].inclusive for n in totals or {}):
        ranges = _scan_ranges(df, group, order, scans, rows_per_bucket)
        out = _carried_on(ranges, group, scans)
        # A running value has the type that the aggregate has.
        out = out.withColumns({n: F.col(n).cast(types[f"_v_{n}"].dataType) for n, s in scans.items() if s.kind != "sum"})
        if totals:
            out = _with_totals(out, group, order, totals)
        return out if keep_bucket else out.drop("_bucket")
    if bucket is None:
        df, bucket = range_cut(df, [*group, *order], rows_per_bucket=rows_per_bucket), F.col("_bucket")
    # A struct is never null, so a null group needs no special join.
    tagged = df.withColumn("_bucket", bucket).withColumn("_group", F.struct(*[F.col(g) for g in group]) if group else F.lit(0))
    keys = ["_group", "_bucket"]
    sums = tagged.groupBy(*keys).agg(*[s.over(s.value).alias(f"_t_{n}") for n, s in scans.items()])
    earlier = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_group")
    carried = sums.select(
        *keys,
        *[s.over(F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, s in scans.items()],
        *[scans[n].over(F.col(f"_t_{n}")).over(whole).alias(name) for n, name in (totals or {}).items()],
    )
    inner = W.partitionBy(*keys).orderBy(*order)
    local = tagged.withColumns({n: s.over(s.value).over(_frame(inner, s)) for n, s in scans.items()})
    # The merge hint keeps the (group, bucket) partitioning and sort of `local`,
    # so only the totals move.
    joined = local.join(carried.hint("merge"), keys)
    return joined.withColumns({n: s.combine(F.col(n), F.col(f"_c_{n}")) for n, s in scans.items()}).drop(
        "_group", *([] if keep_bucket else ["_bucket"]), *[f"_c_{n}" for n in scans]
    )


def _with_totals(rows: DataFrame, group: Sequence[str], order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Add the value that running values have at the end of their group."""
    keyed = rows.withColumn("_group", F.struct(*[F.col(g) for g in group]) if group else F.lit(0))
    last = F.struct(*[F.col(o) for o in order])
    ends = keyed.groupBy("_group").agg(*[F.max_by(n, last).alias(name) for n, name in totals.items()])
    return keyed.join(ends, "_group").drop("_group")


def with_next(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Add to rows that kept their ``_bucket`` what the next row of the group holds:
    ``columns`` maps each value to the name of its successor, null at the group's end.

    Neighbours inside a bucket are seen by a window over (group, bucket). Across
    borders only each bucket's first row of a group travels, one row for each (group,
    bucket).
    """
    keys = ["_group", "_bucket"]
    tagged = df.withColumn("_group", F.struct(*[F.col(g) for g in group]) if group else F.lit(0))
    tagged = tagged.withColumn("_here", F.struct(*columns))
    inside = tagged.withColumn("_next", F.lead("_here").over(W.partitionBy(*keys).orderBy(*order)))
    firsts = tagged.groupBy(*keys).agg(F.min_by("_here", F.struct(*order)).alias("_first"))
    beyond = firsts.withColumn("_beyond", F.lead("_first").over(W.partitionBy("_group").orderBy("_bucket"))).drop("_first")
    # As in the scan, the hint keeps the partitioning of the rows: only borders move.
    joined = inside.join(beyond.hint("merge"), keys).withColumn("_next", F.coalesce("_next", "_beyond"))
    named = {name: F.col("_next")[c] for c, name in columns.items()}
    return joined.withColumns(named).drop("_group", "_here", "_next", "_beyond")


def global_index(
    df: DataFrame,
    order: Sequence[str],
    *,
    group: Sequence[str] = (),
    bucket: Column | None = None,
    name: str = "idx",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Dense zero-based position along ``order`` (within ``group`` when given)."""
    scans = {name: Scan("sum", F.lit(1).cast("long"))}
    counted = prefix_scan(df, group, order, scans, bucket, rows_per_bucket=rows_per_bucket)
    return counted.withColumn(name, F.col(name) - 1)


def _frame(window, scan: Scan):
    return window.rowsBetween(W.unboundedPreceding, 0 if scan.inclusive else -1)
