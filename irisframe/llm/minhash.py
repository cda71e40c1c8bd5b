"""Near-duplicate documents by an inverted join on signature coordinates.

A signature has ``COORDINATES`` min-hash values; two documents agree on each with
a chance equal to their similarity. Documents are posted under their (coordinate,
value) pairs. Since a pair must agree on ``MATCHES`` coordinates, it shares one of
each document's ``COORDINATES - MATCHES + 1`` rarest postings, so only these are
kept (the prefix), and postings nobody else has are skipped. Pairs that meet are
held against both signatures, and those with enough matches are confirmed on
their full shingle sets.

Equal shingle sets are one class throughout. Within a posting list, all members
are first held against one of them; links found are merged into components, and
only members that are still apart are compared with each other.

A link of similarity 0.75 matches on fewer than 28 of 64 coordinates, or on fewer
than 832 of 1024 sketch bits, less than once in ten million times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import bucket_count, judged_documents, stored
from irisframe.llm.components import components
from irisframe.llm.exchange import bucket_of, group_bounds, packed, unpacked
from irisframe.llm.grams import SLICE, Grams, batches, word_hashes, words_of

SHINGLE = 5
SIMILARITY = 75
COORDINATES = 64
MATCHES = 28
SKETCH_BITS = 1024
SKETCH_MATCHES = 832
#: Documents whose sets meet in one confirming task.
BLOCK = 1000

_SHIFT = np.uint64(32)
_ROWS = 2048


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draws = [xxhash.xxh3_64_intdigest(f"{seed}/{i}".encode()) for i in range(2 * count)]
    return np.array(draws[:count], dtype=np.uint64) | np.uint64(1), np.array(draws[count:], dtype=np.uint64)


_SIGNATURE = _functions(COORDINATES, 1)
_SKETCH = _functions(SKETCH_BITS, 2)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles of a lower-cased text; a
    shorter text is one shingle, a text without words has none."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    if len(words) >= SHINGLE:
        return np.unique(Grams(hashes)(SHINGLE))
    return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], dtype=np.uint64)


def _least(values: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper 32 bits of the minimum of each hash function over the set."""
    factor, term = functions
    out = np.full(len(factor), np.iinfo(np.uint32).max, dtype=np.uint32)
    step = max(1, _ROWS * COORDINATES // len(factor))
    for at in range(0, len(values), step):
        hashed = values[at : at + step, None] * factor
        hashed += term
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, (hashed >> _SHIFT).astype(np.uint32).min(axis=0), out=out)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set) and signature of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column("text").to_pylist()
            for a, b in batches([len(t or "") for t in texts], SLICE):
                sets = [shingles(t) for t in texts[a:b]]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "class": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "signature": pa.array([_least(s, _SIGNATURE).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class binary, signature binary")


def _prefixes(classes: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, keys): the rarest postings of each document that others have too."""

    def post(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.uint64) << _SHIFT
        for batch in rows:
            for a, b in batches([1] * batch.num_rows, 1 << 14):
                part = batch.slice(a, b - a)
                values = unpacked(part, "signature", "u4").reshape(-1, COORDINATES)
                keys = (values.astype(np.uint64) | place).ravel()
                docs = np.repeat(part.column("doc_id").to_numpy(), COORDINATES)
                yield packed(bucket_of(keys, buckets), key=keys, doc=docs)

    def count(table: pa.Table) -> pa.Table:
        key, doc = unpacked(table, "key", "u8"), unpacked(table, "doc", "i8")
        order = np.argsort(key)
        begin, group = group_bounds(key[order])
        frequency = np.diff(np.append(begin, len(key)))[group]
        kept = frequency > 1
        order, frequency = order[kept], frequency[kept]
        found = packed(bucket_of(doc[order], buckets), doc=doc[order], key=key[order], frequency=frequency.astype(np.int64))
        return pa.Table.from_batches([found])

    def choose(table: pa.Table) -> pa.Table:
        doc, key, frequency = unpacked(table, "doc", "i8"), unpacked(table, "key", "u8"), unpacked(table, "frequency", "i8")
        order = np.lexsort((key, frequency, doc))
        doc, key = doc[order], key[order]
        begin, group = group_bounds(doc)
        size = np.diff(np.append(begin, len(doc)))
        # Postings that nobody else has are the rarest and fill the prefix first.
        room = np.maximum(0, size - MATCHES + 1)
        kept = np.arange(len(doc)) - begin[group] < room[group]
        at = np.flatnonzero(room)
        keys = [key[begin[g] : begin[g] + room[g]].tobytes() for g in at]
        assert kept.sum() == room.sum()
        return pa.table({"doc_id": pa.array(doc[begin[at]], pa.int64()), "keys": pa.array(keys, pa.binary())})

    sent = classes.mapInArrow(post, "bucket int, key binary, doc binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "bucket int, doc binary, key binary, frequency binary")
    return counted.groupBy("bucket").applyInArrow(choose, "doc_id long, keys binary")


def _sketched(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """doc_id, keys, n, shingles and sketch of posted documents. A sketch holds the
    signature, the mask of posted coordinates, and the bits."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column("text").to_pylist()
            for a, b in batches([len(t or "") for t in texts], SLICE):
                sets = [shingles(t) for t in texts[a:b]]
                part = batch.slice(a, b - a)
                sketches = []
                for s, keys in zip(sets, part.column("keys").to_pylist()):
                    posted = np.zeros(COORDINATES, dtype=np.uint8)
                    posted[(np.frombuffer(keys, "u8") >> _SHIFT).astype(np.int64)] = 1
                    bits = np.packbits((_least(s, _SKETCH) & 1).astype(np.uint8))
                    sketches.append(_least(s, _SIGNATURE).tobytes() + posted.tobytes() + bits.tobytes())
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "keys": part.column("keys"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                        "sketch": pa.array(sketches, pa.binary()),
                    }
                )

    return docs.join(prefixes, "doc_id").mapInArrow(run, "doc_id long, keys binary, n long, shingles binary, sketch binary")


_SKETCH_BYTES = 5 * COORDINATES + SKETCH_BITS // 8


class _Members:
    """Sizes, components and sketches of the documents of a task."""

    def __init__(self, doc: np.ndarray, size: np.ndarray, component: np.ndarray, sketches: np.ndarray):
        self.doc, self.size, self.component = doc, size, component
        self.values = np.ascontiguousarray(sketches[:, : 4 * COORDINATES]).view(np.uint32)
        self.posted = sketches[:, 4 * COORDINATES : 5 * COORDINATES].astype(bool)
        self.bits = sketches[:, 5 * COORDINATES :]

    def close(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may reach the similarity with ``one``."""
        n, m = self.size[one], self.size[others]
        others = others[100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)]
        others = others[(self.values[others] == self.values[one]).sum(axis=1) >= MATCHES]
        differ = np.bitwise_count(self.bits[others] ^ self.bits[one]).sum(axis=1, dtype=np.int64)
        return others[SKETCH_BITS - differ >= SKETCH_MATCHES]

    def met_here(self, one: int, others: np.ndarray, key: int) -> np.ndarray:
        """Those whose first shared posting with ``one`` is this list, so that a pair
        is looked at in one of its lists only."""
        shared = (self.values[others] == self.values[one]) & self.posted[others] & self.posted[one]
        return others[shared.argmax(axis=1) == key >> 32]

    def apart(self, members: np.ndarray, key: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, others it must be confirmed with) over different components."""
        label = self.component[members]
        # The largest component's members are only ever the other side.
        labels, counts = np.unique(label, return_counts=True)
        outside = label != labels[counts.argmax()]
        places = np.arange(len(members))
        for i in np.flatnonzero(outside):
            other = members[(label != label[i]) & (~outside | (places > i))]
            near = self.close(members[i], other)
            if len(near):
                yield members[i], self.met_here(members[i], near, key)


def _posted_rows(posted: DataFrame, buckets: int) -> DataFrame:
    """Every posting with its document's sketch, packed by bucket of the key."""

    def post(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in batches([len(k.as_py()) for k in batch.column("keys")], 1 << 19):
                part = batch.slice(a, b - a)
                counts = np.array([len(k.as_py()) // 8 for k in part.column("keys")])
                key = unpacked(part, "keys", "u8")
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=f"V{_SKETCH_BYTES}")
                columns = {n: np.repeat(part.column(n).to_numpy(), counts) for n in ("doc_id", "n", "component")}
                yield packed(bucket_of(key, buckets), key=key, sketch=np.repeat(sketch, counts), **columns)

    return posted.mapInArrow(post, "bucket int, key binary, sketch binary, doc_id binary, n binary, component binary")


def _lists(table: pa.Table) -> tuple[_Members, Iterator[tuple[int, np.ndarray]]]:
    """A bucket's postings, and (key, members by doc_id) of its lists that hold more
    than one component."""
    key, doc, size, component = (unpacked(table, n, k) for n, k in (("key", "u8"), ("doc_id", "i8"), ("n", "i8"), ("component", "i8")))
    members = _Members(doc, size, component, unpacked(table, "sketch", "u1").reshape(-1, _SKETCH_BYTES))
    order = np.lexsort((doc, key))
    begin, _ = group_bounds(key[order])

    def lists() -> Iterator[tuple[int, np.ndarray]]:
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist()):
            label = component[order[a:b]]
            if b - a > 1 and (label != label[0]).any():
                yield int(key[order[a]]), order[a:b]

    return members, lists()


def _first_meetings(posted: DataFrame, buckets: int) -> DataFrame:
    """(a, b, list): each list's members with its smallest one, where they match."""

    def meet(table: pa.Table) -> pa.Table:
        members, lists = _lists(table)
        found = [(members.doc[m[0]], members.doc[members.close(m[0], m[1:])], key) for key, m in lists]
        right = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        counts = [len(f[1]) for f in found]
        left = np.repeat(np.array([f[0] for f in found], dtype=np.int64), counts)
        return pa.table({"a": left, "b": right, "list": np.repeat(np.array([f[2] for f in found], dtype=np.int64), counts)})

    met = _posted_rows(posted, buckets).groupBy("bucket").applyInArrow(meet, "a long, b long, list long")
    return met.groupBy("a", "b").agg(F.min("list").alias("list"))


def _late_links(posted: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """(a, b): links between documents that are still in different components.

    Lists name the documents that have somebody to be confirmed with; their sets
    are sent to the list, where pairs are compared and only links are given out.
    Long lists are compared in blocks.
    """

    def name(table: pa.Table) -> pa.Table:
        members, lists = _lists(table)
        wanted: list[tuple[int, int]] = []
        for key, listed in lists:
            who = {d for i, near in members.apart(listed, key) if len(near) for d in (int(members.doc[i]), *members.doc[near].tolist())}
            wanted += [(key, d) for d in who]
        return pa.table({"list": pa.array([w[0] for w in wanted], pa.int64()), "doc_id": pa.array([w[1] for w in wanted], pa.int64())})

    wanted = stored(_posted_rows(posted, buckets).groupBy("bucket").applyInArrow(name, "list long, doc_id long"), "minhash-apart")
    parts = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = wanted.join(parts, "list").select("list", "doc_id", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("list", "doc_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = dealt.join(posted.join(sets.select("doc_id", "shingles"), "doc_id"), "doc_id")

    def confirm(table: pa.Table) -> pa.Table:
        doc, size, component, block = (table.column(c).to_numpy() for c in ("doc_id", "n", "component", "block"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, _SKETCH_BYTES)
        members = _Members(doc, size, component, sketches)
        sets = table.column("shingles").to_pylist()
        low, high, key = (table.column(c)[0].as_py() for c in ("low", "high", "list"))
        linked = []
        joined = {int(c): int(c) for c in component}
        for i, near in members.apart(np.argsort(doc), key):
            for j in near.tolist():
                a, b = int(component[i]), int(component[j])
                if {int(block[i]), int(block[j])} == {low, high} and joined[a] != joined[b] and _similar(sets[i], sets[j]):
                    old, new = joined[a], joined[b]
                    joined = {c: new if x == old else x for c, x in joined.items()}
                    linked.append((min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j]))))
        return pa.table({"a": pa.array([p[0] for p in linked], pa.int64()), "b": pa.array([p[1] for p in linked], pa.int64())})

    columns = ["list", "low", "high", "block", "doc_id", "n", "component", "sketch", "shingles"]
    return rows.select(*columns).groupBy("list", "low", "high").applyInArrow(confirm, "a long, b long")


def _similar(x: bytes, y: bytes) -> bool:
    """Whether two packed sets reach the similarity."""
    both = np.frombuffer(x + y, "u8").copy()
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILARITY * (len(both) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of pairs whose full sets reach the similarity.

    Pairs of a list are confirmed together, so that each set is sent once for many
    pairs; long lists are cut into blocks of documents on either side.
    """
    needed = pairs.select("list", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    parts = needed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    block = [F.pmod(F.xxhash64(c), F.col("parts")).cast("int").alias(f"block_{c}") for c in ("a", "b")]
    dealt = stored(pairs.join(parts, "list").select("a", "b", "list", *block), "minhash-pairs")
    where = ["list", "block_a", "block_b"]
    wanted = dealt.select(*where, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shipped = wanted.join(sets.select("doc_id", "shingles"), "doc_id").select(*[F.col(c).alias(f"_{c}") for c in where], "doc_id", "shingles")

    def confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = dict(zip(sets.column("doc_id").to_pylist(), sets.column("shingles").to_pylist()))
        linked = [(a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()) if _similar(of[a], of[b])]
        return pa.table({"a": pa.array([p[0] for p in linked], pa.int64()), "b": pa.array([p[1] for p in linked], pa.int64())})

    return dealt.groupBy(*where).cogroup(shipped.groupBy(*[f"_{c}" for c in where])).applyInArrow(confirm, "a long, b long")


def _with_components(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posted.withColumn("component", F.col("doc_id"))
    return posted.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per judged document."""
    judged = judged_documents(docs)
    buckets = bucket_count(judged)
    signed = stored(_signed(judged), "minhash-signatures")
    whole = signed.filter("class is not null")
    classes = whole.groupBy("class").agg(F.min("doc_id").alias("first"))
    first = stored(whole.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "signature"), "minhash-classes")
    prefixes = stored(_prefixes(first, buckets), "minhash-prefixes")
    posted = stored(_sketched(judged, prefixes), "minhash-posted")
    slim = posted.select("doc_id", "keys", "n", "sketch")
    links = stored(_confirmed(_first_meetings(_with_components(slim, None), buckets), posted), "minhash-links")
    labels = components(links)
    late = stored(_late_links(_with_components(slim, labels), posted, buckets), "minhash-links")
    if not late.isEmpty():
        joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(joined.unionByName(late))
    rows = signed.select("doc_id", "n_shingles", "class").join(classes, "class", "left")
    found = F.coalesce("component", "first", "doc_id")
    return (
        rows.join(labels, F.col("first") == F.col("node"), "left")
        .select("doc_id", "n_shingles", found.alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def judge(docs: DataFrame) -> DataFrame:
    """Every row with ``_n_shingles``, ``_component_id`` and ``_kept``.

    Input columns come back inside ``_in``. Rows without doc_id are linked with
    nothing: they are kept, without a component. Rows that share a doc_id are one
    document, judged by the smallest of its texts.
    """
    found = near_duplicates(docs).select(
        F.col("doc_id").alias("_id"), F.col("n_shingles").alias("_n_shingles"), F.col("component_id").alias("_component_id"), F.col("kept").alias("_kept")
    )
    rows = docs.select(F.struct("*").alias("_in"), F.col("doc_id").cast("long").alias("_doc"))
    joined = rows.join(found, F.col("_doc") == F.col("_id"), "left")
    return joined.select("_in", "_n_shingles", "_component_id", F.coalesce("_kept", F.lit(True)).alias("_kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with its own columns."""
    return judge(docs).filter("_kept").select("_in.*")
