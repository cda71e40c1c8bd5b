"""Image pipelines: one Python pass per pipeline, batched, with seeded draws.

Spark partitions the image table and computes every random draw as a column
(a hash of seed, epoch, row id and step), so an augmented image does not depend
on where it is processed. All steps of a pipeline share one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IMAGENET_MEAN, IMAGENET_STD, SPLITS, SYMMETRIC_MEAN, SYMMETRIC_STD
from ..functions.hashing import unit_uniform

# Pixels per yielded batch, whatever the image size.
PIXELS_PER_YIELD = 1 << 24

Kernel = Callable[[np.ndarray, Sequence[float]], np.ndarray]


@dataclass(frozen=True)
class Step:
    """A kernel on one (height, width, channel) float array.

    ``draws`` uniform numbers in [0, 1) are passed to it. With ``chance`` below
    1, one more draw decides whether the step runs. ``channels``, if set, is the
    only channel count it takes, ``least`` the smallest (height, width). ``size`` is
    the (height, width) it leaves, if that is fixed. ``pixels`` says whether it
    leaves pixels, which 8-bit tools round.
    """

    name: str
    kernel: Kernel
    draws: int = 0
    chance: float = 1.0
    channels: int | None = None
    least: tuple[int, int] | None = None
    size: tuple[int, int] | None = None
    pixels: bool = True


def _fault(steps: Sequence[Step], pixels: str, binary: bool) -> Column:
    """Why an image cannot be processed; null if it can."""
    size = F.octet_length(pixels) if binary else F.size(pixels)
    shape = F.col("height") * F.col("width") * F.col("channels")
    fault = F.when(F.col(pixels).isNull() | shape.isNull(), "no pixels").when(size != shape, "wrong size")
    for count in {s.channels for s in steps if s.channels is not None}:
        fault = fault.when(F.col("channels") != count, "wrong channel count")
    height, width = F.col("height"), F.col("width")
    for step in steps:
        if step.least:
            fault = fault.when((height < step.least[0]) | (width < step.least[1]), f"too small for {step.name}")
        if step.size:
            height, width = F.lit(step.size[0]), F.lit(step.size[1])
    return fault


def rejected_images(df: DataFrame, steps: Sequence[Step], *, pixels: str = "data") -> DataFrame:
    """Images that ``apply_steps`` leaves out, with a reason."""
    fault = _fault(steps, pixels, dict(df.dtypes)[pixels] == "binary")
    return df.withColumn("reason", fault).filter(F.col("reason").isNotNull())


def apply_steps(
    df: DataFrame,
    steps: Sequence[Step],
    row_id: str,
    *,
    seed: int = SPLITS.seed,
    epoch: int = 0,
    pixels: str = "data",
    eight_bit: bool = False,
) -> DataFrame:
    """Apply ``steps``; replaces height, width, channels and adds ``px`` (flat floats).

    ``pixels`` names the input column: 8-bit bytes, or an array of numbers. Steps
    compute in floats and round nothing in between; with ``eight_bit`` pixels are
    rounded (half up) and clipped to 0..255 after every step, like those of tools
    that hold 8-bit pixels throughout. Images that do not fit are left out;
    ``rejected_images`` names them.
    """
    drawn = df.filter(_fault(steps, pixels, dict(df.dtypes)[pixels] == "binary").isNull())
    spans = []
    at = 0
    for i, step in enumerate(steps):
        need = step.draws + (step.chance < 1)
        for j in range(need):
            tag = F.lit(f"{i}.{step.name}.{j}")
            drawn = drawn.withColumn(f"_u{at + j}", unit_uniform(seed, epoch, F.col(row_id), tag))
        spans.append((at, at + need))
        at += need
    binary = dict(df.dtypes)[pixels] == "binary"
    out_type = "array<float>" if binary else "array<double>"
    dtype = np.float32 if binary else np.float64

    names = [n for n in df.columns if n != pixels]

    def transform(raw, shape, u: np.ndarray) -> np.ndarray:
        img = np.frombuffer(raw.as_buffer(), np.uint8) if binary else raw.values.to_numpy()
        img = img.astype(dtype).reshape(shape)
        for step, (lo, hi) in zip(steps, spans):
            draws = u[lo:hi]
            if step.chance == 1 or draws[-1] < step.chance:
                img = step.kernel(img, draws)
                if eight_bit and step.pixels:
                    img = np.clip(np.floor(img + dtype(0.5)), 0, 255)
        return np.ascontiguousarray(img, dtype)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn_columns = [batch.column(f"_u{k}").to_numpy() for k in range(at)]
            u = np.column_stack(drawn_columns) if at else np.empty((batch.num_rows, 0))
            shapes = zip(*[batch.column(c).to_pylist() for c in ("height", "width", "channels")])
            start, done, held = 0, [], 0
            for row, (raw, shape) in enumerate(zip(batch.column(pixels), shapes)):
                done.append(transform(raw, shape, u[row]))
                held += done[-1].size
                if held >= PIXELS_PER_YIELD or row + 1 == batch.num_rows:
                    yield _packed(batch.select(names).slice(start, len(done)), done)
                    start, done, held = row + 1, [], 0

    fields = [f"`{n}` {t}" for n, t in df.dtypes if n != pixels]
    return drawn.mapInArrow(apply, ", ".join([*fields, f"px {out_type}"]))


def _packed(rest: pa.RecordBatch, done: list[np.ndarray]) -> pa.RecordBatch:
    """Other columns, new sizes, and all pixels as one flat buffer with offsets."""
    columns = {n: rest.column(n) for n in rest.schema.names}
    for i, name in enumerate(("height", "width", "channels")):
        columns[name] = pa.array([img.shape[i] for img in done], rest.schema.field(name).type)
    offsets = np.concatenate([[0], np.cumsum([img.size for img in done])]).astype(np.int32)
    flat = pa.array(np.concatenate([img.ravel() for img in done]))
    columns["px"] = pa.ListArray.from_arrays(offsets, flat)
    return pa.RecordBatch.from_pydict(columns)


# Kernels ---------------------------------------------------------------------


@lru_cache(maxsize=64)
def _resize_weights(n_in: int, n_out: int, antialias: bool) -> np.ndarray:
    """(n_out, n_in) bilinear weights with pixel centres at half integers."""
    scale = n_in / n_out
    reach = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    if not antialias:
        centre = np.clip(centre, 0, n_in - 1)
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(n_in)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def _channelwise(rows: np.ndarray, img: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """rows @ channel @ cols.T for every channel, in the image's precision."""
    rows, cols = rows.astype(img.dtype), cols.astype(img.dtype)
    return (rows @ np.moveaxis(img, 2, 0) @ cols.T).transpose(1, 2, 0)


def resize(height: int, width: int, antialias: bool = False) -> Step:
    def kernel(img, _):
        rows = _resize_weights(img.shape[0], height, antialias)
        return _channelwise(rows, img, _resize_weights(img.shape[1], width, antialias))

    return Step("resize", kernel, size=(height, width))


def flip_horizontal(chance: float = 0.5) -> Step:
    return Step("flip_horizontal", lambda img, _: img[:, ::-1], chance=chance)


def flip_vertical(chance: float = 0.2) -> Step:
    return Step("flip_vertical", lambda img, _: img[::-1], chance=chance)


def random_crop(height: int, width: int) -> Step:
    def kernel(img, u):
        top = int(u[0] * (img.shape[0] - height + 1))
        left = int(u[1] * (img.shape[1] - width + 1))
        return img[top : top + height, left : left + width]

    return Step("random_crop", kernel, draws=2, least=(height, width), size=(height, width))


def _warp(img: np.ndarray, matrix: np.ndarray, border: str, nearest: bool) -> np.ndarray:
    """Sample the image at matrix @ (x, y, 1), both measured from the centre."""
    h, w = img.shape[:2]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    dx, dy = x - cx, y - cy
    sx = matrix[0, 0] * dx + matrix[0, 1] * dy + matrix[0, 2] + cx
    sy = matrix[1, 0] * dx + matrix[1, 1] * dy + matrix[1, 2] + cy
    if nearest:
        sx, sy = np.floor(sx + 0.5), np.floor(sy + 0.5)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = [f[..., None].astype(img.dtype) for f in (sx - x0, sy - y0)]
    flat = img.reshape(h * w, -1)

    def pick(yy, xx):
        if border == "reflect":
            return flat.take(_mirror(yy, h) * w + _mirror(xx, w), axis=0)
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return flat.take(np.clip(yy, 0, h - 1) * w + np.clip(xx, 0, w - 1), axis=0) * inside[..., None]

    top = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
    bottom = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + bottom * fy


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Reflect an index about the border pixels without repeating them."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def _rotation(degrees: float, scale: float = 1.0, shift=(0.0, 0.0)) -> np.ndarray:
    """Inverse of: rotate counter-clockwise about the centre, scale, then shift."""
    a = np.deg2rad(degrees)
    c, s = np.cos(a) / scale, np.sin(a) / scale
    return np.array([[c, -s, -c * shift[0] + s * shift[1]], [s, c, -s * shift[0] - c * shift[1]]])


def rotate(limit: float, chance: float = 1.0, border: str = "reflect", nearest: bool = False) -> Step:
    def kernel(img, u):
        return _warp(img, _rotation((2 * u[0] - 1) * limit), border, nearest)

    return Step("rotate", kernel, draws=1, chance=chance)


def shift_scale_rotate(shift: float, scale: float, degrees: float, chance: float = 0.5) -> Step:
    """Random affine with a zero border; shifts are fractions of the size."""

    def kernel(img, u):
        h, w = img.shape[:2]
        r = 2 * np.asarray(u[:4]) - 1
        move = (r[2] * shift * w, r[3] * shift * h)
        return _warp(img, _rotation(r[0] * degrees, 1 + r[1] * scale, move), "zero", False)

    return Step("shift_scale_rotate", kernel, draws=4, chance=chance)


def brightness_contrast(limit: float, chance: float = 0.5, high: float = 255.0, low: float = 0.0) -> Step:
    def kernel(img, u):
        contrast, brightness = (2 * u[0] - 1) * limit, (2 * u[1] - 1) * limit
        return np.clip(img * (1 + contrast) + brightness * high, low, high)

    return Step("brightness_contrast", kernel, draws=2, chance=chance)


def _smooth(img: np.ndarray, axis: int) -> np.ndarray:
    """1-2-1 smoothing along one axis with mirrored borders."""
    n = img.shape[axis]
    wide = np.moveaxis(img.take(_mirror(np.arange(-1, n + 1), n), axis=axis), axis, 0)
    return np.moveaxis(wide[:-2] * 0.25 + wide[1:-1] * 0.5 + wide[2:] * 0.25, 0, axis)


def gaussian_blur(chance: float = 0.2) -> Step:
    return Step("gaussian_blur", lambda img, _: _smooth(_smooth(img, 0), 1), chance=chance)


def normalise(mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Step:
    m, s = np.array(mean), np.array(std)

    def kernel(img, _):
        return (img / img.dtype.type(scale) - m.astype(img.dtype)) / s.astype(img.dtype)

    return Step("normalise", kernel, channels=len(m), pixels=False)


def channels_first() -> Step:
    """Channel-first order. The array keeps (height, width, channel) meaning in
    the row's columns; only the element order of ``px`` changes, so it must be last."""
    return Step("channels_first", lambda img, _: img.transpose(2, 0, 1).reshape(img.shape), pixels=False)


# Named recipes: fixed values are the sizes, limits and chances of each recipe.


def train_recipe(size: int = 256) -> list[Step]:
    return [
        resize(size, size),
        flip_horizontal(0.5),
        flip_vertical(0.2),
        rotate(15, 0.5),
        brightness_contrast(0.1, 0.5),
        shift_scale_rotate(0.05, 0.05, 10, 0.5),
        gaussian_blur(0.2),
        normalise(IMAGENET_MEAN, IMAGENET_STD),
        channels_first(),
    ]


def valid_recipe(size: int = 256) -> list[Step]:
    return [resize(size, size), normalise(IMAGENET_MEAN, IMAGENET_STD), channels_first()]


test_recipe = valid_recipe


def gan_recipe(size: int = 256) -> list[Step]:
    return [resize(size, size), normalise(SYMMETRIC_MEAN, SYMMETRIC_STD), channels_first()]


def translation_recipe(size: int = 256) -> list[Step]:
    """Resize a little larger, random crop, random flip, scale to [-1, 1]."""
    return [
        resize(size + 30, size + 30, antialias=True),
        random_crop(size, size),
        flip_horizontal(0.5),
        normalise(SYMMETRIC_MEAN, SYMMETRIC_STD),
        channels_first(),
    ]


def unpaired_recipe(size: int = 256) -> list[Step]:
    """The default of an unpaired set: resize and scale to [-1, 1]."""
    return [
        resize(size, size, antialias=True),
        normalise(SYMMETRIC_MEAN, SYMMETRIC_STD),
        channels_first(),
    ]


def two_stream_train_recipe(size: int = 224) -> list[Step]:
    return [
        resize(size, size, antialias=True),
        flip_horizontal(0.5),
        rotate(10, border="zero", nearest=True),
        normalise(IMAGENET_MEAN, IMAGENET_STD),
        channels_first(),
    ]


def two_stream_test_recipe(size: int = 224) -> list[Step]:
    return [
        resize(size, size, antialias=True),
        normalise(IMAGENET_MEAN, IMAGENET_STD),
        channels_first(),
    ]
