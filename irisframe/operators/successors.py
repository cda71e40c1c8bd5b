"""Improvement rules with a threshold, followed through a run of any length.

A record improves on the best so far if it lies above the best's bound (best + delta,
or best x gain), so each record has one successor: the first later record above its
own bound. The improvements of a run are the chain of successors from its first
record. Rather than walking the chain row by row in one task, the records are cut
into parts along (run, position):

1. Each part finds the successors inside it by descending a tree of block maxima, and
   contracts their chains by pointer doubling: every record knows where its chain
   leaves the part and what happened on the way. Only records by which a chain can
   enter the part (its own running maxima) go on.
2. An exit's successor lies in the first later part whose maximum is above its bound,
   and is there the first entry above it, found by one ordered scan.
3. Exits are followed from part to part by doubling joins, as many as the logarithm of
   the number of parts.

A run may therefore hold the whole log: no task sees more than one part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import ROWS_PER_BUCKET, Scan, _starts, _written, prefix_scan

#: From a best value to the bound that the next one must exceed.
Bound = Callable[[np.ndarray], np.ndarray]


def first_above(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query the first index from ``start`` on whose value exceeds ``bound``,
    or the number of values. Logarithmic steps, each for all queries at once."""
    size = 1 << (max(len(values), 1) - 1).bit_length()
    levels = [np.concatenate((values, np.full(size - len(values), -np.inf)))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).max(axis=1))
    top = len(levels) - 1
    node, height = start.astype(np.int64), np.full(len(start), -1)
    for k in range(top):
        # A left child's block is the beginning of its parent's: look at right ones only.
        look = np.flatnonzero((height < 0) & (node & 1 == 1))
        hit = levels[k][node[look]] > bound[look]
        height[look[hit]] = k
        node[look[~hit]] += 1
        node[height < 0] >>= 1
    height[(height < 0) & (node == 0) & (levels[top][0] > bound)] = top
    for k in range(top, 0, -1):
        at = np.flatnonzero(height == k)
        left = node[at] * 2
        node[at] = np.where(levels[k - 1][left] > bound[at], left, left + 1)
        height[at] = k - 1
    return np.where(height == 0, node, len(values))


def _entries(records: DataFrame, parts: int, bound: Bound, patience: int) -> DataFrame:
    """Per entry of a part: where its chain leaves the part, the waits of ``patience``
    rows on the way, and the record before the first of them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        run, pos, score, head = (pa.concat_arrays([b.column(n) for b in batches]) for n in ("run", "pos", "score", "head"))
        pos, score, head = (np.asarray(a) for a in (pos, score, head))
        own = np.arange(len(pos))
        starts = _starts([run], None, len(pos))
        code = np.cumsum(starts) - 1
        ahead = first_above(score, own + 1, bound(score))
        inside = code[np.minimum(ahead, len(pos) - 1)] == code
        to = np.where((ahead < len(pos)) & inside, ahead, own)
        waits = np.where(to > own, (pos[to] - pos - 1) // patience, 0)
        at = np.where(waits > 0, own, -1)
        # The last record of a chain leads to itself without waits.
        while (to[to] != to).any():
            waits, at, to = waits + waits[to], np.where(at >= 0, at, at[to]), to[to]
        top = pd.Series(score).groupby(code).cummax().to_numpy()
        record = starts | (score > np.append(-np.inf, top[:-1]))
        # Nothing leads into a run's first part: its chain begins at its head.
        kept = np.flatnonzero(np.where(head[starts][code], starts, record))
        to, at = to[kept], at[kept]
        waits = waits[kept] + np.where(head[kept], (pos[kept] - 1) // patience, 0)
        made = {
            "run": run.take(pa.array(kept)),
            "part": pa.array(np.full(len(kept), TaskContext.get().partitionId(), dtype=np.int32)),
            "head": pa.array(head[kept]),
            "pos": pa.array(pos[kept]),
            "score": pa.array(score[kept]),
            "exit_pos": pa.array(pos[to]),
            "exit_score": pa.array(score[to]),
            "waits": pa.array(waits),
            "at_pos": pa.array(pos[at], mask=at < 0),
            "at_best": pa.array(score[at], mask=at < 0),
        }
        yield pa.record_batch(made)

    longs, doubles, kind = T.LongType(), T.DoubleType(), records.schema["run"].dataType
    schema = T.StructType([T.StructField("run", kind), T.StructField("part", T.IntegerType()), T.StructField("head", T.BooleanType())])
    for name, type_ in (("pos", longs), ("score", doubles), ("exit_pos", longs), ("exit_score", doubles), ("waits", longs), ("at_pos", longs), ("at_best", doubles)):
        schema = schema.add(name, type_)
    cut = records.repartitionByRange(parts, "run", "pos").sortWithinPartitions("run", "pos")
    return cut.mapInArrow(contract, schema)


def _targets(exits: DataFrame, tops: pd.DataFrame, bound: Bound) -> DataFrame:
    """``exits`` with their bound and ``target``, the first later part of the run with a
    value above it; exits without one are left out."""
    tops = tops.sort_values("part")
    parts, highest = tops["part"].to_numpy(), tops["top"].to_numpy()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, last, score = (np.asarray(batch.column(n)) for n in ("part", "last_part", "exit_score"))
            limit = bound(score)
            found = first_above(highest, np.searchsorted(parts, part, "right"), limit)
            kept = np.flatnonzero(found < np.searchsorted(parts, last, "right"))
            target = pa.array(parts[found[kept]].astype(np.int32))
            taken = batch.take(pa.array(kept))
            yield pa.record_batch([*taken.columns, target, pa.array(limit[kept])], [*taken.schema.names, "target", "bound"])

    schema = T.StructType(list(exits.schema.fields)).add("target", T.IntegerType()).add("bound", T.DoubleType())
    return exits.mapInArrow(look, schema)


def _steps(entries: DataFrame, tops: pd.DataFrame, bound: Bound, patience: int, rows_per_part: int) -> DataFrame:
    """One row for each exit that has a successor: the exit that it leads to, the waits
    until there, and the record before the first of them."""
    open_entries = entries.filter("NOT head")
    # One row for each run that goes on beyond a part, fewer than parts.
    lasts = open_entries.groupBy("run").agg(F.max("part").alias("last_part")).withColumnRenamed("run", "_run")
    exits = entries.select("run", "part", "exit_pos", "exit_score").distinct()
    exits = exits.join(F.broadcast(lasts), F.col("run").eqNullSafe(F.col("_run"))).drop("_run")
    probes = _targets(exits, tops, bound)
    # From the highest value down; a value equal to a bound does not exceed it.
    line = probes.select("run", "target", (F.lit(0.0) - F.col("bound")).alias("key"), F.lit(0).alias("kind"), F.col("exit_pos").alias("pos"))
    line = line.unionByName(
        open_entries.select("run", F.col("part").alias("target"), (F.lit(0.0) - F.col("score")).alias("key"), F.lit(1).alias("kind"), "pos")
    )
    # A part's entries rise with their position, so the first above a bound is the least.
    scans = {"to": Scan("min", F.when(F.col("kind") == 1, F.col("pos")))}
    linked = prefix_scan(line, ["run", "target"], ["key", "kind", "pos"], scans, rows_per_bucket=rows_per_part)
    linked = linked.filter("kind = 0").select(F.col("run").alias("_run"), F.col("pos").alias("from"), "to")
    exit_best = exits.select(F.col("run").alias("_run2"), F.col("exit_pos").alias("_from"), F.col("exit_score").alias("from_score"))
    named = linked.join(exit_best, F.col("_run").eqNullSafe(F.col("_run2")) & (F.col("from") == F.col("_from")))
    reached = named.join(open_entries, F.col("_run").eqNullSafe(F.col("run")) & (F.col("to") == F.col("pos")))
    edge = F.floor((F.col("to") - F.col("from") - 1) / patience)
    return reached.select(
        "run",
        "from",
        "exit_pos",
        "exit_score",
        (edge + F.col("waits")).alias("waits"),
        F.when(edge > 0, F.col("from")).otherwise(F.col("at_pos")).alias("at_pos"),
        F.when(edge > 0, F.col("from_score")).otherwise(F.col("at_best")).alias("at_best"),
    )


def _onward(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """``rows`` moved on by the step from their exit, if there is one; ``moved`` says so."""
    after = steps.select(*[F.col(c).alias(f"_{c}") for c in steps.columns])
    same = F.col("run").eqNullSafe(F.col("_run")) & (F.col("exit_pos") == F.col("_from"))
    both = rows.join(after, same, "left")
    first = F.col("at_pos").isNotNull()
    return both.select(
        *[c for c in rows.columns if c not in ("exit_pos", "exit_score", "waits", "at_pos", "at_best")],
        F.coalesce("_exit_pos", "exit_pos").alias("exit_pos"),
        F.coalesce("_exit_score", "exit_score").alias("exit_score"),
        (F.col("waits") + F.coalesce("_waits", F.lit(0))).alias("waits"),
        F.when(first, F.col("at_pos")).otherwise(F.col("_at_pos")).alias("at_pos"),
        F.when(first, F.col("at_best")).otherwise(F.col("_at_best")).alias("at_best"),
        F.col("_from").isNotNull().alias("moved"),
    )


def follow_improvements(records: DataFrame, bound: Bound, patience: int, *, rows_per_part: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per run of ``records`` (run, pos, score, head): its improvements, summed up.

    ``head`` marks a run's first record, which sets the best; positions count from 1
    and are unique in a run; scores are neither null nor NaN. Returns the last best
    value and its position, how many whole waits of ``patience`` rows without
    improvement were completed before it, also before the head, and the best value and
    position at the first wait after the head (``at_best``, ``at_pos``, else null).
    Runs without a head are left out.
    """
    stored = _written(records.select("run", "pos", "score", "head"))
    parts = max(1, -(-stored.count() // rows_per_part))
    entries = _entries(stored, parts, bound, patience)
    if parts == 1:
        walked = entries.filter("head")
    else:
        entries = _written(entries)
        walked = entries.filter("head")
        # One row for each part at most: only its first run can have begun earlier.
        tops = entries.filter("NOT head").groupBy("part").agg(F.max("score").alias("top")).toPandas()
        if len(tops):
            steps = _written(_steps(entries, tops, bound, patience, rows_per_part))
            while True:
                longer = _written(_onward(steps, steps))
                steps = longer.drop("moved")
                if longer.filter("moved").isEmpty():
                    break
            walked = _onward(walked, steps)
    return walked.select("run", F.col("exit_score").alias("best"), F.col("exit_pos").alias("pos"), "waits", "at_best", "at_pos")
