"""Removal of passages that stand in an earlier document too.

Candidate windows of ``WINDOW`` words are found by hash: first those under
shared anchors, then those whose own hash occurs in two documents. The windows'
first occurrences are the reference. It is kept in shards, each a suffix automaton
over words; the later documents' candidate passages are streamed through the
shard they belong to, and where the matching statistics reach the threshold the
span goes. The automaton compares words, so no hash decides a removal.

The reference grows with the corpus, so shards are not broadcast to all tasks:
each is sent to the tasks that stream passages against it. A shard's share per
document is one document at most, and a hot shard's passages are split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import bucket_count, judged_documents, stored, text_key
from irisframe.llm.exchange import bucket_of, group_bounds, kept_runs, packed, runs_by_document, shared_runs, unpacked
from irisframe.llm.grams import Grams, word_hashes, words_of

WINDOW = 50
GRAM = 10
#: Words of passages in one task's group, and of reference in one automaton.
SHARD_WORDS = 400_000
AUTOMATON_WORDS = 100_000
#: Windows or words gathered over documents before they are sent on.
SENT_WINDOWS = 500_000


class SuffixAutomaton:
    """Of word sequences, added in ascending document order.

    ``first`` holds, per state, the smallest document that has the state's words.
    """

    def __init__(self):
        self.length, self.link, self.first = [0], [-1], [-1]
        self.next: list[dict[int, int]] = [{}]
        self._breaks = -2

    def add(self, words: list[int], doc: int) -> None:
        self._breaks -= 1
        last = self._extend(0, self._breaks, doc)
        for word in words:
            last = self._extend(last, word, doc)

    def _extend(self, last: int, word: int, doc: int) -> int:
        length, link, follow, first = self.length, self.link, self.next, self.first
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(doc)
        follow.append({})
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            to = follow[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                first.append(first[to])
                follow.append(dict(follow[to]))
                while at >= 0 and follow[at].get(word) == to:
                    follow[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        return new

    def covered(self, words: list[int], doc: int, window: int) -> list[int]:
        """Starts of the windows that an earlier document has."""
        length, link, follow, first = self.length, self.link, self.next, self.first
        found, at, matched = [], 0, 0
        for end, word in enumerate(words, 1):
            while at and word not in follow[at]:
                at = link[at]
                matched = length[at]
            if word in follow[at]:
                at = follow[at][word]
                matched += 1
                if matched > window:
                    while length[link[at]] >= window:
                        at = link[at]
                    matched = min(matched, length[at])
                if matched >= window and first[at] < doc:
                    found.append(end - window)
        return found


def _candidates(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """(doc_id, lo, hi, first): runs of windows whose hash two documents have."""
    runs = shared_runs(docs, "words", window, GRAM, buckets, within=False)

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(c) for c in zip(*held))
            return packed(bucket_of(h, buckets), hash=h, doc=doc, pos=pos)

        for batch in rows:
            for doc, text, lo, hi in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "text", "lo", "hi")]):
                words = words_of(text)
                for a, b in zip(np.frombuffer(lo, "i8").tolist(), np.frombuffer(hi, "i8").tolist()):
                    h = Grams(word_hashes(words[a : b + window - 1]))(window)
                    held.append((h, np.full(len(h), doc), np.arange(a, b, dtype=np.uint32)))
                    size += len(h)
                if size > SENT_WINDOWS:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    def matched(table: pa.Table) -> pa.Table:
        h, doc = unpacked(table, "hash", "u8"), unpacked(table, "doc", "i8")
        order = np.argsort(h)
        begin, group = group_bounds(h[order])
        low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
        kept = (low != high)[group]
        order, first = order[kept], low[group][kept]
        one = np.ones(len(order), dtype=np.uint32)
        found = packed(bucket_of(doc[order], buckets), doc=doc[order], lo=unpacked(table, "pos", "u4")[order], n=one, first=first)
        return pa.Table.from_batches([found])

    sent = docs.join(runs, "doc_id").mapInArrow(hashed, "bucket int, hash binary, doc binary, pos binary")
    shared = sent.groupBy("bucket").applyInArrow(matched, "bucket int, doc binary, lo binary, n binary, first binary")
    return shared.groupBy("bucket").applyInArrow(runs_by_document("first"), "doc_id long, lo binary, hi binary, first binary")


def _passages(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """(key, reference, doc_id, lo, words, n): candidate passages by first document."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        names = ("key", "reference", "doc_id", "lo", "words", "n")
        pieces: list[tuple] = []
        size = 0
        for batch in rows:
            for doc, text, *runs in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "text", "lo", "hi", "first")]):
                words = words_of(text)
                for a, b, first in zip(*[np.frombuffer(r, "i8").tolist() for r in runs]):
                    for at in range(a, b, AUTOMATON_WORDS):
                        end = min(b, at + AUTOMATON_WORDS) + window - 1
                        pieces.append((first, first == doc, doc, at, b" ".join(words[at:end]), end - at))
                        size += end - at
                if size > SENT_WINDOWS:
                    yield pa.record_batch([pa.array([p[i] for p in pieces], k) for i, k in enumerate(kinds)], names)
                    pieces, size = [], 0
        yield pa.record_batch([pa.array([p[i] for p in pieces], k) for i, k in enumerate(kinds)], names)

    schema = "key long, reference boolean, doc_id long, lo long, words binary, n long"
    return docs.join(candidates, "doc_id").mapInArrow(cut, schema)


def _spans(passages: DataFrame, window: int) -> DataFrame:
    """(doc_id, lo, hi): runs of window starts that an earlier document has."""
    sizes = passages.groupBy("key").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    hot = sizes.filter(F.col("size") > SHARD_WORDS).select("key", F.ceil(F.col("size") / SHARD_WORDS).cast("int").alias("parts"))
    dealt = passages.join(stored(hot, "hot-passages"), "key", "left")
    own: Column = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    # A hot key's reference, part of one document, goes along with each part of its passages.
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).when(F.col("reference"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key"))
    dealt = dealt.select("reference", "doc_id", "lo", "words", shard.alias("shard"), F.explode(parts).alias("part"))

    def stream(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(n).to_pylist() for n in ("reference", "doc_id", "lo", "words")]), key=lambda r: r[1:3])
        found: list[tuple[int, int]] = []
        references, size = [], 0
        for at, (doc, words) in enumerate([(r[1], r[3].split(b" ")) for r in rows if r[0]] + [(None, [])]):
            if references and (doc is None or size + len(words) > AUTOMATON_WORDS):
                found += _matches(references, [r[1:] for r in rows if not r[0]], window)
                references, size = [], 0
            references.append((doc, words))
            size += len(words)
        starts = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
        new = np.concatenate(([True], np.any(starts[1:] - starts[:-1] != (0, 1), axis=1))) if len(starts) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(starts)) - 1 if len(begin) else begin
        return pa.table({"doc_id": starts[begin, 0], "lo": starts[begin, 1], "hi": starts[stop, 1] + 1})

    return dealt.groupBy("shard", "part").applyInArrow(stream, "doc_id long, lo long, hi long")


def _matches(references: list[tuple[int, list[bytes]]], passages: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int]]:
    """(doc, window start) of passages found in one reference shard."""
    automaton, ids = SuffixAutomaton(), {}
    for doc, words in references:
        automaton.add([ids.setdefault(w, len(ids)) for w in words], doc)
    return [
        (doc, lo + at)
        for doc, lo, words in passages
        for at in automaton.covered([ids.get(w, -1) for w in words.split(b" ")], doc, window)
    ]


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, spans): per judged document, the window starts to remove.

    Null and empty texts have no words. Texts below a window are never touched.
    """
    judged = judged_documents(docs)
    buckets = bucket_count(judged)
    candidates = stored(_candidates(judged, buckets, window), "substring-candidates")
    passages = stored(_passages(judged, candidates, window), "substring-passages")
    spans = _spans(passages, window).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return spans


def cut_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row with ``_n_words``, ``_n_removed`` and ``_kept``, its remaining words
    joined by one space (null if nothing went).

    Input columns come back inside ``_in``. Rows without doc_id, and rows whose
    doc_id has a smaller text elsewhere, are returned whole; repeated rows are one
    document and lose the same words.
    """
    spans = removed_windows(docs, window)
    rows = docs.select(F.struct("*").alias("_in"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(rows, spans, docs, window)


def _apply(rows: DataFrame, spans: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    keyed = spans.join(_versions(docs), "doc_id", "left")
    fits = F.col("_key").isNull() | (F.col("_key") == text_key())
    joined = rows.join(keyed, "doc_id", "left").withColumn("spans", F.when(fits, F.col("spans")))
    kept = F.struct("text", F.transform("spans", lambda s: s["lo"]).alias("lo"), F.transform("spans", lambda s: s["hi"]).alias("hi"))
    return joined.select("_in", _rewrite(window)(kept).alias("_r")).select("_in", "_r.*")


def _versions(docs: DataFrame) -> DataFrame:
    """(doc_id, _key): the judged text of doc_ids that have several texts."""
    several = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(text_key()).alias("a"), F.max(text_key()).alias("b"), F.min(F.col("text").cast("string")).alias("text")
    )
    return several.filter("a <> b").select("doc_id", text_key().alias("_key"))


def _rewrite(window: int):
    schema = "_n_words long, _n_removed long, _kept string, _kept_sha256 string"

    @F.pandas_udf(schema)
    def rewrite(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, lo, hi in zip(rows["text"], rows["lo"], rows["hi"]):
            words = words_of(text)
            if lo is None or not len(lo):
                out.append((len(words), 0, None, hashlib.sha256(b" ".join(words)).hexdigest()))
                continue
            keep, _ = kept_runs(len(words), np.stack([np.asarray(lo), np.asarray(hi) + window - 1], axis=1))
            left = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
            out.append((len(words), int((~keep).sum()), left.decode("utf-8", "surrogatepass"), hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(out, columns=["_n_words", "_n_removed", "_kept", "_kept_sha256"])

    return rewrite


def drop_passages(docs: DataFrame) -> DataFrame:
    """Documents without repeated passages; those that lost every word are dropped."""
    cut = cut_passages(docs).filter((F.col("_n_removed") == 0) | (F.col("_n_removed") < F.col("_n_words")))
    new = {"text": F.coalesce("_kept", "_in.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") == 0, F.col("_in.n_chars")).otherwise(F.char_length("_kept").cast("long"))
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"_in.`{c}`") for c in docs.columns])
