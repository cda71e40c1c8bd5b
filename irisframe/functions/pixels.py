"""Pixel operations as Spark expressions on flat row-major (height, width,
channel) arrays.

They stay inside the JVM and suit small tensors and single operations; whole
pipelines over large images run batched in :mod:`irisframe.operators.images`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(body: Callable[..., Column], *values: Column) -> Column:
    """``body(*values)`` with every value computed once per row.

    A column used inside an array lambda is otherwise inlined there, and its
    expression (a cast of the array, a hash, a minimum) runs once per element.
    """
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    names = range(len(values))
    return F.get(F.transform(F.array(packed), lambda s: body(*[s[f"v{i}"] for i in names])), F.lit(0))


def _int(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x.cast("int")


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _gather(px: Column, count: Column, source: Callable[..., Column], *values: Column) -> Column:
    """out[i] = px[source(i, *values)] for i in 0..count-1."""
    return evaluated_once(
        lambda p, n, *v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(p, source(i, *v))),
        px,
        count,
        *values,
    )


def flip_horizontal(px: Column, height, width, channels) -> Column:
    h, w, c = _int(height), _int(width), _int(channels)
    return _gather(
        px,
        h * w * c,
        lambda i, row, c: _div(i, row) * row + row - c - (i % row - i % c) + i % c,
        w * c,
        c,
    )


def flip_vertical(px: Column, height, width, channels) -> Column:
    h, w, c = _int(height), _int(width), _int(channels)
    return _gather(px, h * w * c, lambda i, h, row: (h - 1 - _div(i, row)) * row + i % row, h, w * c)


def crop(px: Column, width, channels, top, left, out_height, out_width) -> Column:
    w, c, oh, ow = _int(width), _int(channels), _int(out_height), _int(out_width)
    return _gather(
        px,
        oh * ow * c,
        lambda i, line, row, start: start + _div(i, row) * line + i % row,
        w * c,
        ow * c,
        _int(top) * w * c + _int(left) * c,
    )


def to_channels_first(px: Column, height, width, channels) -> Column:
    h, w, c = _int(height), _int(width), _int(channels)
    return _gather(px, h * w * c, lambda i, area, c: (i % area) * c + _div(i, area), h * w, c)


def normalise(px: Column, mean: Sequence[float], std: Sequence[float], scale: float = 255.0) -> Column:
    """(x / scale - mean[c]) / std[c], channel = position modulo the channel count."""
    n = len(mean)
    if n == 1:
        return F.transform(px, lambda x: (x / scale - mean[0]) / std[0])
    m, s = (F.array(*[F.lit(float(v)) for v in vals]) for vals in (mean, std))
    return F.transform(px, lambda x, i: (x / scale - F.get(m, i % n)) / F.get(s, i % n))


def denormalise(px: Column) -> Column:
    """[-1, 1] to [0, 1]."""
    return F.transform(px, lambda x: (x + 1.0) / 2.0)


def min_max_scale(px: Column) -> Column:
    """Stretch one array to [0, 1]; a constant array becomes zeros."""
    return evaluated_once(
        lambda p, low, high: F.transform(
            p, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        ),
        px,
        F.array_min(px),
        F.array_max(px),
    )


def brightness_contrast(px: Column, contrast: Column, brightness: Column, low: float, high: float) -> Column:
    """x * (1 + contrast) + brightness * high, clipped to [low, high]."""
    return evaluated_once(
        lambda p, gain, lift: F.transform(
            p, lambda x: F.least(F.greatest(x * gain + lift, F.lit(low)), F.lit(high))
        ),
        px,
        1.0 + contrast,
        brightness * high,
    )
