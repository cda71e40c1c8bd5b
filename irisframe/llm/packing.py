"""Packing of tokenized documents into windows of equal length.

A document fills whole windows first; its tail is what gets packed. Tail lengths
are counted in classes of ``QUANTUM`` tokens. All combinations of up to three
classes that fill a window are enumerated, and non-negative least squares finds
how often to use each so that the counts meet the histogram. The rounded counts
are carried out. Tails they leave over are packed greedily, the largest first and
then always the largest that still fits; where that would leave more than one part
in ``SLACK`` of a window empty, tails are laid end to end and cut at window ends.

The driver sees the histogram only, at most ``window / QUANTUM`` numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irisframe.llm.common import stored
from irisframe.llm.parts import byte_slices
from irisframe.llm.tokens import text_encoder

WINDOW = 2048
QUANTUM = 16
END_ID = 1
ROWS_PER_BUCKET = 200_000
#: Greedy windows may stay empty by one part in so many.
SLACK = 128
#: Text bytes tokenized at once.
SLICE_BYTES = 4 << 20


def combinations(units: int, present: list[int]) -> np.ndarray:
    """Rows of up to three classes (0: none) that add up to ``units``."""
    known = set(present)
    found = [(units, 0, 0)] if units in known else []
    for a in present:
        if 2 * a <= units and units - a in known:
            found.append((a, units - a, 0))
        found += [(a, b, units - a - b) for b in present if a <= b <= units - a - b and units - a - b in known]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active-set method."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        if passive.all() or gradient.max(initial=-np.inf) <= tolerance:
            break
        passive[int(gradient.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = trial <= tolerance
            if not low.any():
                x[:] = 0
                x[at] = trial
                break
            old = x[at]
            step = (old[low] / np.maximum(old[low] - trial[low], 1e-300)).min()
            x[at] = old + step * (trial - old)
            gone = at[x[at] <= tolerance]
            x[gone] = 0
            passive[gone] = False
            if not passive.any():
                break
    return x


def greedy_counts(left: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes, repeats) of windows filled with the largest class that fits, again
    and again. Every round uses a class up, or finds that its windows would stay too
    empty and leaves it out, so rounds are bounded by the number of classes."""
    left, out = dict(left), []
    while any(left.values()):
        way: list[int] = []
        space = units
        while fits := [c for c, n in left.items() if c <= space and n > way.count(c)]:
            way.append(max(fits))
            space -= way[-1]
        if space * SLACK > units:
            left[way[0]] = 0
            continue
        repeats = min(left[c] // way.count(c) for c in set(way))
        for c in way:
            left[c] -= repeats
        out.append((tuple(way), repeats))
    return out


def repeat_counts(histogram: Mapping[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes, repeats): the rounded solution, within what the histogram holds."""
    present = sorted(c for c, n in histogram.items() if n)
    ways = combinations(units, present)
    if not len(ways):
        return []
    places = {c: i for i, c in enumerate(present)}
    a = np.zeros((len(present), len(ways)))
    for s, way in enumerate(ways):
        for c in way[way > 0]:
            a[places[c], s] += 1
    b = np.array([histogram[c] for c in present], dtype=float)
    wanted = np.rint(non_negative_least_squares(a, b)).astype(np.int64)
    left, out = b.astype(np.int64), []
    for s in np.argsort(-wanted, kind="stable"):
        use = a[:, s].astype(np.int64)
        n = int(min(wanted[s], (left[use > 0] // use[use > 0]).min()))
        if n > 0:
            left -= n * use
            out.append((tuple(int(c) for c in ways[s] if c), n))
    return out


def tokenized(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """rid, doc_id, tokens, whole windows' checksums, the tail's checksum and ids.

    ``rid`` numbers the rows; it is stored, so later reads agree on it.
    """
    end = end_id.to_bytes(4, "little")
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        encode = text_encoder(vocabulary)
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = [e + end for e in encode(pc.fill_null(part.column("text"), ""))]
                cuts = [len(i) - len(i) % step for i in ids]
                yield pa.record_batch(
                    {
                        "rid": pa.array(range(row, row + len(ids)), pa.int64()),
                        "doc_id": part.column("doc_id"),
                        "tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                        "checks": pa.array([[zlib.crc32(i[k : k + step]) for k in range(0, c, step)] for i, c in zip(ids, cuts)], pa.list_(pa.int64())),
                        "tail_check": pa.array([zlib.crc32(i[c:]) for i, c in zip(ids, cuts)], pa.int64()),
                        "tail": pa.array([i[c:] for i, c in zip(ids, cuts)], pa.binary()),
                    }
                )
                row += len(ids)

    schema = "rid long, doc_id long, tokens long, checks array<long>, tail_check long, tail binary"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(slim.mapInArrow(run, schema), "packing-tokens")


def _running(rows: DataFrame, group: list[str], value: str, name: str, buckets: int) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the group, in buckets by rid."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    keys = [*group, "_b"]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = W.partitionBy(*keys).orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, keys).withColumn(name, F.col("_s") + F.col("_l")).drop("_b", "_s", "_l")


def pack(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is a document of its own, also where a doc_id is null or repeated.
    A null or empty text is the closing id alone. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, vocabulary, window)
    whole = F.expr(f"tokens div {window}")
    slim = rows.select("rid", "doc_id", "tokens", "tail_check", whole.alias("whole"), (F.col("tokens") % window).alias("n"))
    slim = slim.withColumn("class", F.ceil(F.col("n") / quantum).cast("int"))
    counted = slim.groupBy("class").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole")).collect()
    total_rows, total_whole = sum(r["rows"] for r in counted), sum(r["whole"] for r in counted)
    buckets = max(16, -(-total_rows // ROWS_PER_BUCKET))
    histogram = {r["class"]: r["rows"] for r in counted if r["class"]}
    chosen = repeat_counts(histogram, window // quantum)
    for classes, repeats in chosen:
        for c in classes:
            histogram[c] -= repeats
    chosen += greedy_counts(histogram, window // quantum)

    filled = (
        _running(rows.filter(whole > 0).select("rid", "doc_id", "tokens", "checks", whole.alias("whole")), [], "whole", "base", buckets)
        .select("doc_id", "tokens", "base", F.posexplode("checks").alias("at", "check"))
        .select(
            "doc_id",
            (F.col("at").cast("long") * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            F.col("check").alias("ids_crc32"),
            F.col("tokens").alias("doc_tokens"),
            (F.col("base") + F.col("at")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )

    slots, used, sequence = [], {}, total_whole
    for classes, repeats in chosen:
        for slot, c in enumerate(classes):
            slots.append((c, used.get(c, 0), used.get(c, 0) + repeats, sequence, slot))
            used[c] = used.get(c, 0) + repeats
        sequence += repeats
    # Every combination in use has at most window / quantum rows, and there are at
    # most twice as many combinations as classes.
    plan = F.broadcast(spark.createDataFrame(slots, "c int, lo long, hi long, first long, slot int"))
    ranked = _running(slim.filter("n > 0").withColumn("_one", F.lit(1).cast("long")), ["class"], "_one", "k", buckets).drop("_one")
    placed = stored(
        ranked.join(plan, (F.col("class") == F.col("c")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")), "left").select(
            "rid", "doc_id", "tokens", "tail_check", "n", "slot", (F.col("first") + F.col("k") - F.col("lo")).alias("sequence_id")
        ),
        "packing-places",
    )
    start = (F.col("tokens") - F.col("n")).alias("start")
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    combined = placed.filter("slot is not null").select(
        "doc_id",
        start,
        F.col("n").alias("length"),
        F.col("tail_check").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )

    loose = _running(placed.filter("slot is null").select("rid", "doc_id", "tokens", "n"), [], "n", "at", buckets)
    cut = loose.join(rows.select("rid", "tail"), "rid").mapInArrow(_cut_tails(window), _PIECES)
    rest = cut.withColumn("sequence_id", F.col("sequence_id") + sequence)
    return filled.unionByName(combined).unionByName(rest)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut_tails(window: int):
    """Cut tails, laid end to end from position ``at``, at the ends of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, tokens, n, at, tail in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "tokens", "n", "at", "tail")]):
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, window)
                    size = min(n - done, window - offset)
                    out.append((doc, tokens - n + done, size, zlib.crc32(tail[4 * done : 4 * (done + size)]), tokens, sequence, offset))
                    done += size
            yield pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(7)], [c.split()[0] for c in _PIECES.split(", ")])

    return run
