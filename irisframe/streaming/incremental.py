"""Process only files or rows that have not been processed yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.paths import base_name, parent_name
from pyspark.sql import functions as F


def glob_of(path: str) -> str:
    """A glob that matches exactly ``path``; a stream source accepts a single
    file only through a glob."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(glob_of(path))


def image_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """New image files below ``root/<class>/`` as (path, name, class, length)."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
    )
    found = reader.load(f"{root.rstrip('/')}/*/*")
    path = F.col("path")
    return found.select("path", base_name(path).alias("name"), parent_name(path).alias("class"), "length")


def run_pending(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> None:
    """Process everything new, then stop. Run again after new arrivals or a
    failure: the checkpoint and the file sink's log make each row appear once."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
