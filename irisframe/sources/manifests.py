"""Manifests: which images exist, with class and split taken from their path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS
from ..functions.paths import base_name, parent_name
from ..operators.class_index import label_alphabetical, label_declared, split_unknown


def scan_files(
    spark: SparkSession, root: str | Sequence[str], extensions: Sequence[str] | None = IMAGE_EXTENSIONS
) -> DataFrame:
    """(path, name, class, folder, length, modified) of the files below ``root``.

    Only listing columns are read; file content is pruned from the scan.
    ``extensions`` is case-sensitive; None keeps every file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    path = F.col("path")
    return reader.load(root if isinstance(root, str) else list(root)).select(
        "path",
        base_name(path).alias("name"),
        parent_name(path).alias("class"),
        parent_name(path, 2).alias("folder"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """Folder-per-class images with labels in alphabetical class order."""
    return label_alphabetical(scan_files(spark, root))


def split_sets(
    spark: SparkSession, root: str, classes: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(manifest, quarantine) of ``root/<split>/<class>/<image>`` in one listing."""
    found = scan_files(spark, root).withColumnRenamed("folder", "split")
    return split_unknown(label_declared(found, classes))


def domain_listing(spark: SparkSession, root: str, mode: str = "train") -> DataFrame:
    """Files of ``root/<mode>A`` and ``root/<mode>B`` with ``domain`` A or B."""
    found = scan_files(spark, [f"{root}/{mode}A", f"{root}/{mode}B"], extensions=None)
    return found.withColumn("domain", F.right(F.col("class"), F.lit(1))).drop("class", "folder")
