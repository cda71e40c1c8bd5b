"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of cells, a power of two many. Each shard owns several
virtual nodes, and a key belongs to the first node clockwise from its cell. A
shard takes at most its share of rows. Its own keys come first, in ring order;
what finds it full continues clockwise to the next node whose shard has room. As
the shares add up to the number of rows, counts differ by one at most.

How far each cell's keys travel depends on the number of keys per cell alone, so
the walk runs over cell counts (a table bounded by the number of cells); rows
are then matched with it by their rank within the cell. Each row moves once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irisframe.llm.common import stored

VNODES = 64
GRID_BITS = 12
ROWS_PER_CELL = 1_000_000
MAX_CELL_BITS = 20


def ring_owners(shards: int, vnodes: int = VNODES, bits: int = GRID_BITS) -> list[int]:
    """The owner of each of the 2**bits cells; a node's place depends on its shard
    and number only, so one more shard leaves all other nodes where they are."""
    if shards * vnodes > (1 << bits) // 2:
        raise ValueError("too many virtual nodes for the ring")
    size = 1 << bits
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % size
            while at in nodes:
                at = (at + 1) % size
            nodes[at] = shard
    owners, owner = [0] * size, nodes[min(nodes)]
    for cell in range(size - 1, -1, -1):
        owner = nodes.get(cell, owner)
        owners[cell] = owner
    return owners


def walk_clockwise(
    counts: Mapping[int, int], owners: Sequence[int], cells: int, capacity: Sequence[int]
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of every piece of a cell."""
    room, used, pieces = list(capacity), [0] * len(capacity), []
    per_owner = cells // len(owners)

    def take(cell: int, start: int, count: int, shard: int) -> int:
        part = min(count, room[shard])
        if part:
            pieces.append((cell, start, start + part, shard, used[shard]))
            room[shard] -= part
            used[shard] += part
        return part

    left = []
    for cell in sorted(counts):
        got = take(cell, 0, counts[cell], owners[cell // per_owner])
        if got < counts[cell]:
            left.append((cell, got, counts[cell] - got))
    for cell, start, count in left:
        at = cell // per_owner
        while count:
            got = take(cell, start, count, owners[at % len(owners)])
            start, count, at = start + got, count - got, at + 1
    return pieces


def shard_documents(docs: DataFrame, shards: int = 8, *, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``size`` is the UTF-8 length plus 1 (null text: 0 plus 1, CRC 0). Rows without
    doc_id are placed by their text's checksum. Repeated rows are separate rows
    and get slots of their own; only doc_id and text are read, so further columns
    do no harm. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    ).withColumn(
        "_h", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    )
    rows = stored(rows, "ring-rows")
    total = rows.count()
    bits = min(MAX_CELL_BITS, max(GRID_BITS, (total // ROWS_PER_CELL).bit_length()))
    celled = rows.withColumn("_cell", F.shiftrightunsigned("_h", 64 - bits).cast("int"))

    # At most 2**MAX_CELL_BITS counts, whatever the number of rows.
    counts = {r["_cell"]: r["n"] for r in celled.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = walk_clockwise(counts, ring_owners(shards, vnodes), 1 << bits, capacity)
    plan = spark.range(1).select(
        F.inline(
            F.from_json(
                F.lit(json.dumps([dict(zip(("c", "lo", "hi", "shard", "base"), p)) for p in pieces])),
                "array<struct<c:int,lo:long,hi:long,shard:int,base:long>>",
            )
        )
    )

    order = W.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = celled.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(
        F.broadcast(plan), (F.col("_cell") == F.col("c")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
