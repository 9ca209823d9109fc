"""Rectangles as arrays [x0, y0, x1, y1] in shares of a page, and colours."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PIXELS = 12_000_000


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def union_rect(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def glyph_rect(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, width: Column, page_width: Column, page_height: Column) -> Column:
    """The box of a run of glyphs under the affine map (a, b, c, d, e, f), as shares of the page from
    its top; null if it is empty. The run is `width` long and as high as the map's second axis."""
    height, angle = F.hypot(c, d), F.atan2(b, a)
    dx, dy = width * F.cos(angle), width * F.sin(angle)
    hx, hy = -height * F.sin(angle), height * F.cos(angle)
    xs = F.array(e, e + dx, e + hx, e + dx + hx)
    ys = F.array(f, f + dy, f + hy, f + dy + hy)
    box = F.array(clamp(F.array_min(xs) / page_width), clamp(1 - F.array_max(ys) / page_height), clamp(F.array_max(xs) / page_width), clamp(1 - F.array_min(ys) / page_height))
    return F.when((box[2] > box[0]) & (box[3] > box[1]), box)


def rescaled(box: Column, width: Column, height: Column) -> Column:
    """A box in pixels as shares of the page."""
    return F.array(clamp(box[0] / width), clamp(box[1] / height), clamp(box[2] / width), clamp(box[3] / height))


def raster_scale(width: Column, height: Column, dpi: int = 300) -> Column:
    """Pixels per point, less where the page would have more than MAX_PIXELS."""
    scale = F.lit(dpi / 72)
    return F.least(scale, F.lit(sqrt(MAX_PIXELS)) / F.sqrt(width * height))


def rgb_to_hex(rgb: Column) -> Column:
    parts = F.transform(rgb, lambda v: F.lower(F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("long")), 2, "0")))
    return F.concat(F.lit("#"), F.array_join(parts, ""))


def hex_to_rgb(colour: Column) -> Column:
    return F.array(*[F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)])
