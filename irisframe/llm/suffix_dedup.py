"""Removal of byte strings that start earlier in the corpus too.

Candidate passages, those under shared anchors, are gathered in shards by the
smallest document that has the anchor, so equal strings meet. Each shard gets a
suffix array and the common prefixes of neighbours; strings of ``LENGTH`` bytes
with a common prefix that long are one class, and all but its first occurrence
go. Documents that share with very many others fill several shards: these hand
on the sorted digests of their classes, which are merged by binary search to find
classes that another shard has earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import bucket_count, judged_documents, stored, text_key
from irisframe.llm.exchange import kept_runs, shared_runs, unpacked
from irisframe.llm.grams import Grams, byte_hashes
from irisframe.llm.suffix import common_prefixes, joined, suffix_array

LENGTH = 100
GRAM = 32
SHARD_BYTES = 3 << 20
MERGE_RANGES = 16


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, whole): documents whose whole text an earlier document has."""
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first")
    return digests.join(first, "digest").filter("doc_id > first").select("doc_id", F.lit(True).alias("whole"))


def _passages(docs: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """(owner, doc_id, lo, raw): candidate strings of documents that are no copies."""
    runs = shared_runs(docs, "bytes", length, GRAM, bucket_count(docs), within=True)

    step = SHARD_BYTES // 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts: list[tuple[int, int, int, bytes]] = []
            size = 0
            for doc, text, *runs in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "text", "lo", "hi", "owner")]):
                raw = text.encode("utf-8", "surrogatepass")
                for a, b, owner in zip(*[np.frombuffer(r, "i8").tolist() for r in runs]):
                    # Long runs are cut so that a document can spread over shards.
                    parts += [(owner, doc, at, raw[at : min(b, at + step) + length - 1]) for at in range(a, b, step)]
                    size += b - a
                if size > SHARD_BYTES:
                    yield pa.record_batch([pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)], ["owner", "doc_id", "lo", "raw"])
                    parts, size = [], 0
            yield pa.record_batch([pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)], ["owner", "doc_id", "lo", "raw"])

    kept = runs.join(copies, "doc_id", "left_anti")
    return docs.join(kept, "doc_id").mapInArrow(cut, "owner long, doc_id long, lo long, raw binary")


def _runs(doc: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Single (doc, window start) places as runs."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))) if len(doc) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc))[: len(begin)] - 1
    return {"doc_id": doc[begin], "lo": at[begin], "hi": at[last] + 1}


def shard_repeats(docs: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int):
    """Repeats inside one shard, whose passages come in (document, start) order.

    Returns (doc, window start) of windows that are not the first of their class,
    and (doc, window start, passage, offset) of those that are.
    """
    symbols, begins = joined(texts)
    order, keys = suffix_array(symbols)
    prefixes = common_prefixes(order, keys, begins, length)
    sizes = np.array([len(t) for t in texts])
    passage = np.searchsorted(begins, order, side="right") - 1
    offset = order - begins[passage]
    whole = offset + length <= sizes[passage]
    group = np.cumsum(np.append(True, prefixes[1:] < length))
    place, passage, offset, group = order[whole], passage[whole], offset[whole], group[whole]
    new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=bool)
    first = np.minimum.reduceat(place, np.flatnonzero(new)) if len(place) else place
    is_first = np.zeros(len(symbols), dtype=bool)
    is_first[first] = True
    lead = is_first[place]
    doc, at = docs[passage], starts[passage] + offset
    return (doc[~lead], at[~lead]), (doc[lead], at[lead], passage[lead], offset[lead])


_FOUND = "doc_id long, lo long, hi long, owner long, cut int, digests binary, docs binary, starts binary"


def _shard(length: int):
    """One shard's repeats, and its classes' digests if other shards have the owner too."""

    def run(table: pa.Table) -> pa.Table:
        doc, lo = table.column("doc_id").to_numpy(), table.column("lo").to_numpy()
        order = np.lexsort((lo, doc))
        raw = table.column("raw").to_pylist()
        texts = [raw[i] for i in order]
        (gone_doc, gone_at), (doc_of, at, passage, offset) = shard_repeats(doc[order], lo[order], texts, length)
        found = _runs(gone_doc, gone_at)
        out = {n: pa.array(v, pa.int64()) for n, v in found.items()}
        rows = len(found["lo"])
        split = table.column("part")[0].as_py() >= 0
        cuts: list[tuple] = []
        if split and len(at):
            symbols = np.concatenate([byte_hashes(t) for t in texts])
            sizes = np.array([len(t) for t in texts])
            digest = Grams(symbols)(length)[(np.cumsum(sizes) - sizes)[passage] + offset]
            by = np.argsort(digest)
            digest, doc_of, at = digest[by], doc_of[by], at[by]
            edges = np.searchsorted(digest, np.arange(1, MERGE_RANGES, dtype=np.uint64) << np.uint64(60))
            bounds = [0, *edges.tolist(), len(digest)]
            cuts = [(k, digest[a:b].tobytes(), doc_of[a:b].tobytes(), at[a:b].tobytes()) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        owner = table.column("shard")[0].as_py()
        for name in ("doc_id", "lo", "hi"):
            out[name] = pa.concat_arrays([out[name], pa.nulls(len(cuts), pa.int64())])
        out["owner"] = pa.array([None] * rows + [owner] * len(cuts), pa.int64())
        for i, (name, kind) in enumerate((("cut", pa.int32()), ("digests", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()))):
            out[name] = pa.array([None] * rows + [c[i] for c in cuts], kind)
        return pa.table(out)

    return run


def merge_classes(table: pa.Table) -> pa.Table:
    """Windows whose class another shard of the same owner has earlier."""
    parts = [[np.frombuffer(v, k) for v, k in zip(row, ("u8", "i8", "i8"))] for row in zip(*[table.column(n).to_pylist() for n in ("digests", "docs", "starts")])]
    doc, at = unpacked(table, "docs", "i8"), unpacked(table, "starts", "i8")
    rank = np.empty(len(doc), dtype=np.int64)
    rank[np.lexsort((at, doc))] = np.arange(len(doc))
    classes = np.unique(np.concatenate([p[0] for p in parts]))
    # Each shard's digests are sorted, so they are found in the merged order by binary search.
    places = np.concatenate([np.searchsorted(classes, p[0]) for p in parts])
    first = np.full(len(classes), len(doc), dtype=np.int64)
    np.minimum.at(first, places, rank)
    late = rank > first[places]
    return pa.table(_runs(doc[late], at[late]))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans, whole): window starts to remove, or all of a later copy."""
    judged = judged_documents(docs)
    copies = stored(_copies(judged), "suffix-copies")
    passages = stored(_passages(judged, copies, length), "suffix-passages")
    sizes = passages.groupBy("owner").agg(F.sum(F.octet_length("raw")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = sizes.filter(F.col("size") > SHARD_BYTES).select("owner", F.ceil(F.col("size") / SHARD_BYTES).cast("int").alias("parts"))
    dealt = passages.join(stored(hot, "suffix-hot"), "owner", "left").select(
        "doc_id",
        "lo",
        "raw",
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("owner"), F.lit(shards))).otherwise(F.col("owner")).alias("shard"),
        F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "lo"), F.col("parts"))).cast("int").alias("part"),
    )
    found = stored(dealt.groupBy("shard", "part").applyInArrow(_shard(length), _FOUND), "suffix-shards")
    merged = found.filter("cut is not null").groupBy("owner", "cut").applyInArrow(merge_classes, "doc_id long, lo long, hi long")
    spans = found.filter("cut is null").select("doc_id", "lo", "hi").unionByName(merged)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)), allowMissingColumns=True)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row with ``_n_bytes``, ``_n_removed``, ``_n_spans`` and ``_kept`` (binary).

    A null text is empty. Input columns come back inside ``_in``. Rows without
    doc_id, and rows whose doc_id has a smaller text elsewhere, are returned whole;
    repeated rows are one document and lose the same bytes.
    """
    several = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(text_key()).alias("a"), F.max(text_key()).alias("b"), F.min(F.col("text").cast("string")).alias("text")
    )
    versions = several.filter("a <> b").select("doc_id", text_key().alias("_key"))
    keyed = repeated_windows(docs, length).join(versions, "doc_id", "left")
    rows = docs.select(F.struct("*").alias("_in"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fits = F.col("_key").isNull() | (F.col("_key") == text_key())
    joined_rows = rows.join(keyed, "doc_id", "left").withColumn("spans", F.when(fits, F.col("spans"))).withColumn("whole", fits & F.col("whole"))
    given = F.struct(
        "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.transform("spans", lambda s: s["lo"]).alias("lo"), F.transform("spans", lambda s: s["hi"]).alias("hi")
    )

    @F.pandas_udf("_n_bytes long, _n_removed long, _n_spans long, _kept binary")
    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, whole, lo, hi in zip(rows["text"], rows["whole"], rows["lo"], rows["hi"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if whole and len(raw) >= length:
                out.append((len(raw), len(raw), 1, b""))
            elif lo is None or not len(lo):
                out.append((len(raw), 0, 0, raw))
            else:
                keep, runs = kept_runs(len(raw), np.stack([np.asarray(lo), np.asarray(hi) + length - 1], axis=1))
                left = np.frombuffer(raw, dtype=np.uint8)[keep].tobytes()
                out.append((len(raw), len(raw) - len(left), runs, left))
        return pd.DataFrame(out, columns=["_n_bytes", "_n_removed", "_n_spans", "_kept"])

    return joined_rows.select("_in", rewrite(given).alias("_r")).select("_in", "_r.*")

