"""Class labels: declared order, alphabetical order, and rows of unknown class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import declared_index
from .ordered import global_index
from .small import evaluated_if_small


def label_declared(df: DataFrame, classes: Sequence[str], column: str = "class") -> DataFrame:
    """Add ``label`` from the declared list; null marks an unknown class."""
    return df.withColumn("label", declared_index(F.col(column), classes))


def split_unknown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled, quarantined) rows; an unknown class is never a silent null."""
    return df.filter(F.col("label").isNotNull()), df.filter(F.col("label").isNull())


def label_alphabetical(df: DataFrame, column: str = "class") -> DataFrame:
    """Add ``label``: position of the class among the sorted distinct classes; null
    where there is no class."""
    classes = df.select(column).filter(F.col(column).isNotNull()).distinct()
    local = evaluated_if_small(classes)
    if local is None:
        labels = global_index(classes, [column], name="label")
    else:
        rank = F.row_number().over(W.orderBy(column))
        labels = F.broadcast(local.withColumn("label", rank - 1))
    return df.join(labels.withColumn("label", F.col("label").cast("int")), column, "left")
