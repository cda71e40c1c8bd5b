"""Training items of two image sets: pairs of paths with both images transformed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPLITS
from .images import Step, apply_steps


def paired_tensors(
    pairs: DataFrame,
    images: DataFrame,
    steps: Sequence[Step],
    row_id: str,
    *,
    left: str = "real_path",
    right: str = "synthetic_path",
    path: str = "path",
    pixels: str = "data",
    seed: int = SPLITS.seed,
    epoch: int = 0,
) -> DataFrame:
    """``pairs`` with structs ``left`` and ``right`` (height, width, channels, px).

    ``images`` has one row per ``path``. Each side draws its own random numbers,
    from the pair's ``row_id``. A side whose image is missing or does not fit the
    steps is null, so no pair is lost.
    """
    out = pairs
    for offset, (side, column) in enumerate((("left", left), ("right", right))):
        wanted = pairs.select(F.col(row_id).alias("_row"), F.col(column).alias("_path"))
        held = images.select(F.col(path).alias("_path"), "height", "width", "channels", pixels)
        done = apply_steps(wanted.join(held, "_path"), steps, "_row", seed=seed + offset, epoch=epoch, pixels=pixels)
        tensor = F.struct("height", "width", "channels", "px").alias(side)
        made = done.select(F.col("_row").alias(row_id), tensor)
        out = out.join(made, row_id, "left")
    return out
