"""Columns derived from file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column, levels: int = 1) -> Column:
    """Name of the directory ``levels`` above the file; null if the path is too short."""
    return F.try_element_at(F.split(path, "/"), F.lit(-1 - levels))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Case-sensitive extension test."""
    return F.element_at(F.split(base_name(path), r"\."), -1).isin(*extensions)


def synthetic_name(index: Column, domain: str) -> Column:
    """File name of the image generated from zero-based position ``index``."""
    return F.format_string(f"synthetic_{domain}_%d.png", index + 1)


def synthetic_number(name: Column, domain: str) -> Column:
    """Inverse of :func:`synthetic_name`: the one-based number, null if not a match."""
    digits = F.regexp_extract(name, rf"synthetic_{domain}_(\d+)\.png$", 1)
    return F.when(digits != "", digits.cast("long"))


def declared_index(name: Column, classes: Sequence[str]) -> Column:
    """Position of a class in the declared list; null when it is not listed."""
    pairs = [x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), name)
