"""Decoding image files to RGB rows and storing image tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SCHEMA = "path string, height int, width int, channels int, data binary"


def read_images(spark: SparkSession, root: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(decoded, unreadable): RGB bytes in row-major order, and paths that failed.

    The JVM decodes; only the channel order is changed in Python.
    """
    raw = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "false")
        .load(root if isinstance(root, str) else list(root))
        .select("image.*")
    )
    broken = raw.filter(F.col("height") < 0).select(F.col("origin").alias("path"))
    good = raw.filter(F.col("height") >= 0)
    rgb = good.select("origin", "height", "width", "nChannels", "data").mapInPandas(_to_rgb, IMAGE_SCHEMA)
    return rgb, broken


def _to_rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        data = [
            _rgb_bytes(np.frombuffer(d, np.uint8).reshape(-1, c))
            for d, c in zip(pdf["data"], pdf["nChannels"])
        ]
        yield pd.DataFrame(
            {
                "path": pdf["origin"],
                "height": pdf["height"],
                "width": pdf["width"],
                "channels": np.int32(3),
                "data": data,
            }
        )


def _rgb_bytes(pixels: np.ndarray) -> bytes:
    """Gray is repeated; blue-green-red(-alpha) is reversed and alpha dropped."""
    if pixels.shape[1] == 1:
        return np.repeat(pixels, 3, axis=1).tobytes()
    return np.ascontiguousarray(pixels[:, 2::-1]).tobytes()


def image_bytes(tensors: DataFrame, *, stretch: bool = False) -> DataFrame:
    """[0, 1] channel-last tensors as 8-bit image rows; ``stretch`` min-max scales first.
    A null tensor has null bytes, an empty one none, and null or NaN values are 0."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for px in batch.column("px"):
                if not px.is_valid:
                    rows.append(None)
                    continue
                v = np.nan_to_num(px.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if stretch and v.size:
                    low, high = v.min(), v.max()
                    v = (v - low) / max(high - low, 1e-5)
                # Round half up after scaling, then clip.
                rows.append(np.clip(v * 255 + 0.5, 0, 255).astype(np.uint8).tobytes())
            columns = {n: batch.column(n) for n in batch.schema.names if n != "px"}
            yield pa.RecordBatch.from_pydict({**columns, "data": pa.array(rows, pa.binary())})

    fields = [f"`{n}` {t}" for n, t in tensors.dtypes if n != "px"]
    return tensors.mapInArrow(convert, ", ".join([*fields, "data binary"]))


def first_samples(df: DataFrame, row_id: str, count: int = 4) -> DataFrame:
    """The preview rows of a job: the lowest ids, as a top-k and not a full sort."""
    return df.orderBy(row_id).limit(count)
