"""Seeded hashes: every random choice is a function of a row's own key.

Nothing depends on partitioning, task retries or row order, so a recomputed
partition gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined by ``:``; strings name columns, ints are literals."""
    cols = [F.lit(str(p)) if isinstance(p, int) else _col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_prefix(h: Column, digits: int = 3) -> Column:
    """Leading hex digits: an order-preserving bucket with 16**digits uniform cells."""
    return F.substring(h, 1, digits)


def hash_int(h: Column) -> Column:
    """The first 60 bits of a hex digest as a non-negative long."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def unit_uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1) that depends only on the parts."""
    return hash_int(seeded_hash(*parts)) / F.lit(float(1 << 60))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
