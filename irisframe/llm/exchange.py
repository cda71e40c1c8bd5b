"""Which windows of a document may stand elsewhere too.

Every window of a fixed length has an anchor, the smallest hash of the short
grams inside it, so equal windows have equal anchors. Anchors are dealt over
buckets by hash, where those that occur once drop out; what remains is sent back
to its documents. A bucket holds packed arrays, and an anchor occurs once per
about half a window, so the exchange is a small share of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from irisframe.llm.grams import SLICE, Grams, anchors, batches, byte_hashes, cut_long, laid_end_to_end, word_hashes, words_of

_DOC_MIX = np.uint64(0x9E3779B97F4A7C15)


def units_of(text: str | None, kind: str) -> np.ndarray:
    """Hashes of a text's words or bytes."""
    if kind == "words":
        return word_hashes(words_of(text))
    return byte_hashes((text or "").encode("utf-8", "surrogatepass"))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for every hash or document number."""
    mixed = values.astype(np.uint64, copy=False) * _DOC_MIX
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def packed(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, its values as packed arrays."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
    ends = np.append(first[1:], len(ordered)).tolist()
    made = {"bucket": pa.array(ordered[first], pa.int32())}
    for name, values in columns.items():
        values = values[order]
        made[name] = pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())
    return pa.record_batch(made)


def unpacked(table: pa.Table | pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def group_bounds(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and each value's run number."""
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def text_slices(batch: pa.RecordBatch, kind: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(doc, start in the doc, units) of texts with a window, in bounded amounts."""
    docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    for low, high in batches([len(t or "") for t in texts], SLICE * (6 if kind == "words" else 1)):
        found = []
        for doc, text in zip(docs[low:high], texts[low:high]):
            units = units_of(text, kind)
            if len(units) >= length:
                found += [(doc, a, units[a:b]) for a, b in cut_long(len(units), length)]
        for a, b in batches([len(f[2]) for f in found], SLICE):
            part = found[a:b]
            yield np.array([f[0] for f in part]), np.array([f[1] for f in part]), [f[2] for f in part]


def shared_runs(docs: DataFrame, kind: str, length: int, gram: int, buckets: int, *, within: bool) -> DataFrame:
    """(doc_id, lo, hi, owner): packed runs of window starts under shared anchors.

    ``owner`` is the smallest document with the run's anchor. An anchor is shared
    if two documents hold it or, with ``within``, if it occurs twice at all.
    """
    width = length - gram + 1

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for doc, start, units in text_slices(batch, kind, length):
                joined, begins, valid = laid_end_to_end(units, length)
                hashes = Grams(joined)(gram)
                at, first, end = anchors(hashes, width, valid)
                if not len(at):
                    continue
                text = np.searchsorted(begins, first, side="right") - 1
                # Neighbours with equal anchors, as in periodic text, become one entry.
                h = hashes[at]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (first[1:] != end[:-1])))
                begin = np.flatnonzero(new)
                times = np.minimum(np.diff(np.append(begin, len(h))), 2).astype(np.uint8)
                stop = end[np.append(begin[1:], len(h)) - 1]
                lo = first[begin] - begins[text[begin]] + start[text[begin]]
                h = h[begin]
                yield packed(
                    bucket_of(h, buckets), hash=h, doc=doc[text[begin]], lo=lo.astype(np.uint32), n=(stop - first[begin]).astype(np.uint32), times=times
                )

    def match(table: pa.Table) -> pa.Table:
        h, doc = unpacked(table, "hash", "u8"), unpacked(table, "doc", "i8")
        order = np.argsort(h)
        begin, group = group_bounds(h[order])
        ordered = doc[order]
        low, high = np.minimum.reduceat(ordered, begin), np.maximum.reduceat(ordered, begin)
        shared = low != high
        if within:
            shared |= np.add.reduceat(unpacked(table, "times", "u1")[order].astype(np.int64), begin) > 1
        kept = shared[group]
        order, owner = order[kept], low[group][kept]
        doc = doc[order]
        found = packed(bucket_of(doc, buckets), doc=doc, lo=unpacked(table, "lo", "u4")[order], n=unpacked(table, "n", "u4")[order], owner=owner)
        return pa.Table.from_batches([found])

    sent = docs.mapInArrow(find, "bucket int, hash binary, doc binary, lo binary, n binary, times binary")
    shared = sent.groupBy("bucket").applyInArrow(match, "bucket int, doc binary, lo binary, n binary, owner binary")
    return shared.groupBy("bucket").applyInArrow(runs_by_document("owner"), "doc_id long, lo binary, hi binary, owner binary")


def runs_by_document(tag: str) -> Callable[[pa.Table], pa.Table]:
    """Join the (doc, lo, n, tag) of a bucket to runs, one row per document."""

    def collect(table: pa.Table) -> pa.Table:
        doc, mark = unpacked(table, "doc", "i8"), unpacked(table, tag, "i8")
        lo, n = unpacked(table, "lo", "u4").astype(np.int64), unpacked(table, "n", "u4").astype(np.int64)
        order = np.lexsort((lo, doc))
        doc, mark, lo, n = doc[order], mark[order], lo[order], n[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (lo[1:] != lo[:-1] + n[:-1])))
        begin = np.flatnonzero(new)
        hi = np.append(begin[1:], len(doc)) - 1
        runs = {"lo": lo[begin], "hi": (lo + n)[hi], tag: mark[begin]}
        starts, _ = group_bounds(doc[begin])
        ends = np.append(starts[1:], len(begin)).tolist()
        out = {"doc_id": pa.array(doc[begin][starts], pa.int64())}
        for name, values in runs.items():
            out[name] = pa.array([values[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary())
        return pa.table(out)

    return collect


def kept_runs(size: int, removed: np.ndarray) -> tuple[np.ndarray, int]:
    """(kept units as a mask, number of maximal removed runs)."""
    marks = np.zeros(size + 1, dtype=np.int32)
    np.add.at(marks, np.clip(removed[:, 0], 0, size), 1)
    np.add.at(marks, np.clip(removed[:, 1], 0, size), -1)
    gone = np.cumsum(marks[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if size else 0
    return ~gone, runs
