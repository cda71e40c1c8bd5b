"""Byte-level BPE encoding and decoding by recursive queries inside Spark tasks.

Spark spreads the documents; each task holds an in-memory DuckDB with the merge
table. Texts fall into pieces by the tokenizer's pattern, and each distinct piece
is encoded once per worker: a recursive query keeps one row per (piece, position,
token), joins neighbours with the merge table, and contracts every piece's
leftmost pair of least rank until none is left; its first position stays in every
step, so the last step with it is the result. Decoding joins the ids with the
vocabulary and aggregates their bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irisframe.llm.grams import batches as slices
from irisframe.llm.pieces import Recent, cut, text_of

#: A piece of more bytes is contracted with a heap: the query takes a step per
#: merge, so its work would grow with the square of the length.
QUERY_BYTES = 200
#: Pieces and uncut parts of texts whose encodings a worker remembers, twice at most.
PIECES = 200_000
PARTS = 160_000
#: Pieces in one recursive query, which keeps a row for each byte and step.
ASKED = 40_000
#: Characters encoded and ids decoded at once.
SLICE_CHARS = 2 << 20
DECODED_IDS = 200_000

_ENCODE = """
WITH RECURSIVE parts(step, w, pos, tok, next_tok, next_pos) AS (
    SELECT 0, w, pos, tok, next_tok, next_pos FROM start
  UNION ALL
    SELECT step + 1, w, pos, tok, lead(tok) OVER word, lead(pos) OVER word
    FROM (
        SELECT step, w, pos, CASE WHEN pos = best & 1023 THEN CAST(best >> 10 AS INTEGER) ELSE tok END AS tok
        FROM parts JOIN (
            SELECT w, min((CAST(id AS BIGINT) << 10) + pos) AS best, arg_min(next_pos, (CAST(id AS BIGINT) << 10) + pos) AS gone
            FROM parts JOIN merges ON tok = l AND next_tok = r
            GROUP BY w
        ) USING (w)
        WHERE pos <> gone
    )
    WINDOW word AS (PARTITION BY w ORDER BY pos)
)
SELECT w, string_agg(tok, ',') AS ids
FROM (
    SELECT w, tok
    FROM parts JOIN (SELECT w, max(step) AS step FROM parts WHERE pos = 0 GROUP BY w) USING (w, step)
    ORDER BY w, pos
)
GROUP BY w
"""

#: A token's bytes are held as the letters of the same code. Here and above one thread
#: aggregates the rows in the order that the subquery gives them.
_DECODE = """
SELECT d, string_agg(letters, '') AS raw
FROM (SELECT d, letters FROM encoded JOIN vocabulary USING (tok) ORDER BY pos)
GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to make a token of two tokens; a token's rank is its id."""
    found = [
        (ranks[token[:cut]], ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    return pa.table({name: pa.array([f[i] for f in found], pa.int32()) for i, name in enumerate(("l", "r", "id"))})


def contract_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same rule, leftmost pair of least rank first, in n log n steps."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after = [*range(1, len(parts)), -1]
    before = [*range(-1, len(parts) - 1)]
    heap: list[tuple[int, int, bytes]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] >= 0:
            both = parts[at] + parts[after[at]]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], at, both))

    for at in range(len(parts)):
        offer(at)
    while heap:
        _, at, both = heapq.heappop(heap)
        gone = after[at] if parts[at] is not None else -1
        if gone < 0 or parts[at] + parts[gone] != both:
            continue
        parts[at], parts[gone] = both, None
        after[at] = after[gone]
        if after[gone] >= 0:
            before[after[gone]] = at
        offer(before[at])
        offer(at)
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Encoder and decoder of one worker, kept for its later tasks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": tempfile.gettempdir()})
        tokens = pa.table(
            {"tok": pa.array(self.ranks.values(), pa.int32()), "letters": pa.array([t.decode("latin-1") for t in self.ranks])}
        )
        for name, table in (("merges", merge_table(self.ranks)), ("vocabulary", tokens)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pieces = Recent(PIECES, QUERY_BYTES)
        self.parts = Recent(PARTS, QUERY_BYTES)

    def _encode_pieces(self, pieces: list[str]) -> list[str]:
        """Ids of pieces as the pattern cuts them, as decimal text."""
        out, asked, raws = [""] * len(pieces), [], []
        for i, piece in enumerate(pieces):
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                out[i] = str(self.ranks[raw])
            elif len(raw) > QUERY_BYTES:
                out[i] = ",".join(map(str, contract_by_heap(raw, self.ranks)))
            else:
                asked.append(i)
                raws.append(raw)
        for at in range(0, len(asked), ASKED):
            self.db.register("start", self._positions(raws[at : at + ASKED]))
            for w, ids in self.db.execute(_ENCODE).fetchall():
                out[asked[at + w]] = ids
            self.db.unregister("start")
        return out

    def _encode_parts(self, parts: list[str]) -> list[str]:
        found = [self.pattern.findall(text_of(p)) for p in parts]
        known = self.pieces.of(found, self._encode_pieces)
        return [",".join([known[p] for p in pieces]) for pieces in found]

    def _positions(self, raws: list[bytes]) -> pa.Table:
        """One row per byte of each piece, with its follower (-1 at the end)."""
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        tok = self.of_byte[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.cumsum(sizes) - 1
        next_tok, next_pos = np.append(tok[1:], -1), pos + 1
        next_tok[last] = next_pos[last] = -1
        named = {"w": np.repeat(np.arange(len(raws)), sizes), "pos": pos, "tok": tok, "next_tok": next_tok, "next_pos": next_pos}
        return pa.table({n: pa.array(v.astype(np.int32)) for n, v in named.items()})

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, joined by commas."""
        parts = [cut(t) for t in texts]
        known = self.parts.of(parts, self._encode_parts)
        # A text that starts with a space has an empty part before it.
        return [",".join([known[p] for p in found if known[p]]) for found in parts]

    def decode(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids."""
        counts = [t.count(",") + 1 if t else 0 for t in texts]
        tok = np.fromstring(",".join(filter(None, texts)), dtype=np.int32, sep=",")
        d = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        self.db.register("encoded", pa.table({"d": d, "pos": np.arange(len(tok)), "tok": tok}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("encoded")
        return [found.get(d, "").encode("latin-1") for d in range(len(texts))]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with the ids as decimal text joined by commas.

    A null text counts as empty and has no ids. Rows stand alone: repeated rows
    and rows without doc_id are encoded like others, and only doc_id and text are
    read. ``ranks_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in slices(map(len, texts), SLICE_CHARS):
                ids = codec(ranks_path, pattern).encode(texts[a:b])
                yield pa.record_batch({"doc_id": docs.slice(a, b - a), "ids": pa.array(ids, pa.large_string())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encodes each
    text and decodes the ids again. Edge cases as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or codec(ranks_path, pattern)
            ids = [t or "" for t in batch.column("ids").to_pylist()]
            counts = [t.count(",") + 1 if t else 0 for t in ids]
            decoded = [raw for a, b in slices(counts, DECODED_IDS) for raw in coder.decode(ids[a:b])]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                }
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_documents(docs, ranks_path, pattern).mapInArrow(run, schema)
