"""Rasters packed into one array per row, row by row from the top left pixel.

Sampling is a column expression over the packed array: no pixel becomes a row, and nothing is shuffled. A null raster
is null inside and zero outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import camera as C


def remap(values: Column, w: int, h: int, size: tuple[int, int], place: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A raster of `size` (width, height) whose pixel (x, y) is the value at `place(x, y)`, between the four pixels around it.

    Pixels outside count as zero. Places, then cells, are arrays of their own, so that each is worked out once.
    """
    to_w, to_h = size

    def spot(p: Column) -> Column:
        x, y = place(p % to_w, F.floor(p / to_w))
        return F.struct(x.alias("x"), y.alias("y"))

    def cell(q: Column) -> Column:
        i, j = F.floor(q.x).cast("int"), F.floor(q.y).cast("int")
        return F.struct(i.alias("i"), j.alias("j"), (q.x - i).alias("fx"), (q.y - j).alias("fy"))

    def sample(q: Column) -> Column:
        def at(i: Column, j: Column) -> Column:
            inside = (i >= 0) & (i < w) & (j >= 0) & (j < h)
            return F.when(inside, F.get(values, j * w + i)).otherwise(F.lit(0.0))

        top = at(q.i, q.j) * (1 - q.fx) + at(q.i + 1, q.j) * q.fx
        low = at(q.i, q.j + 1) * (1 - q.fx) + at(q.i + 1, q.j + 1) * q.fx
        return top * (1 - q.fy) + low * q.fy

    return F.transform(F.transform(F.transform(F.sequence(F.lit(0), F.lit(to_w * to_h - 1)), spot), cell), sample)


def resize(values: Column, w: int, h: int, size: tuple[int, int]) -> Column:
    """Bilinear resize by pixel centres; the border's pixels extend outwards."""

    def place(x: Column, y: Column) -> tuple[Column, Column]:
        def one(p: Column, n: int, to: int) -> Column:
            return F.least(F.greatest((p + 0.5) * n / to - 0.5, F.lit(0.0)), F.lit(n - 1.0))

        return one(x, w, size[0]), one(y, h, size[1])

    return remap(values, w, h, size, place)


def undistort(values: Column, w: int, h: int, model: str, f: Column, k1: Column, k2: Column) -> Column:
    """The image that a pinhole camera of the same focal length would have taken."""

    def place(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = (x - w / 2) / f, (y - h / 2) / f
        s = C.distortion(model, u, v, k1, k2)
        return u * s * f + w / 2, v * s * f + h / 2

    return remap(values, w, h, (w, h), place)


def panorama_view(values: Column, w: int, h: int, size: tuple[int, int], f: Column, roll: Column, pitch: Column, yaw: Column) -> Column:
    """What a pinhole camera sees of an equirectangular panorama of w x h pixels."""

    def place(x: Column, y: Column) -> tuple[Column, Column]:
        lon, lat = C.panorama_angles((x - size[0] / 2) / f, (y - size[1] / 2) / f, roll, pitch, yaw)
        return (lon / C.TURN + 0.5) * (w - 1), (lat / (C.TURN / 2) + 0.5) * (h - 1)

    return remap(values, w, h, size, place)


def black_share(channels: list[Column]) -> Column:
    """Share of pixels at which every channel is zero; null for an image without pixels."""
    total = channels[0]
    for c in channels[1:]:
        total = F.zip_with(total, c, lambda a, b: F.abs(a) + F.abs(b))
    return F.try_divide(F.size(F.filter(total, lambda x: x == 0)).cast("double"), F.size(total))


def tiled(images: list[Column], w: int, h: int, across: int) -> Column:
    """Images of one size in a grid of `across` columns, as one raster; places left over are zero."""
    rows = -(-len(images) // across)
    blank = F.array_repeat(F.lit(0.0), w * h)
    all_ = [*images, *[blank] * (rows * across - len(images))]
    lines = [F.slice(all_[r * across + c], y * w + 1, w) for r in range(rows) for y in range(h) for c in range(across)]
    return F.concat(*lines)
