"""Near-duplicate documents by SimHash fingerprints that differ in a few bits.

A fingerprint falls into ``BLOCKS`` blocks. Two that differ in at most ``DISTANCE``
bits agree on at least ``BLOCKS - DISTANCE`` of them (pigeonhole), so every choice of
that many blocks is a join key: fingerprints are posted under all choices, joined on
equal keys, and verified by their Hamming distance.

Equal fingerprints are one row throughout. A key that more than ``CROWD``
fingerprints hold is not joined, since its pairs would grow with the square of the
crowd. Its members meet under all fingerprints at most one flipped bit away instead:
two fingerprints share such a midpoint if, and only if, they differ in at most two
bits, so linking the members of a midpoint to its smallest one finds the same
components with 65 rows for each member. Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irisframe.llm.common import joined_on_hot_key, judged_documents, stored
from irisframe.llm.components import components
from irisframe.llm.grams import words_of
from irisframe.llm.parts import byte_slices

SHINGLE = 3
SEED = 42
#: Links are fingerprints that differ in this many bits at most; midpoints need two.
DISTANCE = 2
BLOCKS = 5
CROWD = 64
SLICE_BYTES = 8 << 20
_ROWS = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's
    three-word shingles, repeats included. Fewer words are one shingle; a null text
    or one without words has fingerprint 0."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    n = max(1, len(words) - SHINGLE + 1)
    ends = (starts + sizes - 1)[-n:]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _ROWS):
        spans = zip(starts[at : min(n, at + _ROWS)].tolist(), ends[at : at + _ROWS].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in byte_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A mask of 64 bits, as a signed number, for each choice of blocks that agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    sums = [sum(chosen) for chosen in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """(a, b): links between the rows (first, fp), enough to join all components."""
    masks = F.array(*[F.lit(m) for m in block_masks()])
    post = classes.select("first", "fp", F.posexplode(masks).alias("choice", "mask"))
    post = post.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "first")
    sizes = post.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(post.join(sizes, ["choice", "key"]), "simhash-posts")

    sparse = shared.filter(f"n <= {CROWD}")
    left = sparse.select("choice", "key", F.col("fp").alias("x"), F.col("first").alias("a"))
    right = sparse.select(F.col("choice").alias("c"), F.col("key").alias("k"), F.col("fp").alias("y"), F.col("first").alias("b"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE
    same = (F.col("choice") == F.col("c")) & (F.col("key") == F.col("k")) & (F.col("x") < F.col("y")) & near
    pairs = left.join(right, same).select("a", "b")

    flips = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    crowded = shared.filter(f"n > {CROWD}").select("fp", "first").distinct()
    around = crowded.select("first", "fp", F.explode(flips).alias("flip")).select("first", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    around = stored(around, "simhash-midpoints")
    least = around.groupBy("mid").agg(F.min("first").alias("b"), F.count("*").alias("n")).filter("n > 1")
    met = around.join(least, "mid").filter("first <> b").select(F.col("first").alias("a"), "b")
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document, and one for each
    row without doc_id.

    Rows that share a doc_id are one document; if their texts differ, the smallest
    text is the one that is judged. Rows without doc_id have a fingerprint but are
    linked with nothing, and their component is null. Documents without words share
    fingerprint 0 and are linked like any other. Only doc_id and text are read.
    """
    judged = stored(fingerprints(judged_documents(docs)), "simhash-fingerprints")
    classes = stored(judged.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-classes")
    labels = components(fingerprint_links(classes.select("first", "fp")))
    known = classes.join(labels, F.col("first") == F.col("node"), "left").select("fp", "rows", F.coalesce("component", "first").alias("component_id"))
    found = joined_on_hot_key(judged, stored(known, "simhash-components"), "fp", "rows")
    others = fingerprints(docs.filter("doc_id is null")).withColumn("component_id", F.lit(None).cast("long"))
    out = found.select("doc_id", "fp", "component_id").unionByName(others)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
