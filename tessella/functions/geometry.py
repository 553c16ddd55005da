"""Rectangles on a slide, its pyramid of levels, and low-resolution masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def physical_size(pixels: Column, microns_per_pixel: Column) -> Column:
    return F.round(pixels * microns_per_pixel, 6)


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two rectangles with keys x, y, w and h share area; touching edges share none."""
    apart = (a["x"] + a["w"] <= b["x"]) | (b["x"] + b["w"] <= a["x"]) | (a["y"] + a["h"] <= b["y"]) | (b["y"] + b["h"] <= a["y"])
    return ~apart


def rectangle(of: Column) -> dict[str, Column]:
    return {k: of[k] for k in "xywh"}


def read_level(downsamples: Column, width: Column, height: Column, output: int) -> Column:
    """The last level that still has at least ``output`` pixels a side, else 0."""
    wanted = F.greatest(F.lit(1.0), F.least(width.cast("double") / output, height.cast("double") / output))
    levels = F.filter(F.sequence(F.lit(0), F.size(downsamples) - 1), lambda i: F.element_at(downsamples, i + 1) <= wanted)
    return F.coalesce(F.array_max(levels), F.lit(0)).cast("int")


def read_size(pixels: Column, downsample: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(pixels / downsample)).cast("long")


def padding(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """How far a rectangle reaches over each side of its slide."""
    none = F.lit(0).cast("long")
    sides = {"left": -x, "top": -y, "right": x + w - width, "bottom": y + h - height}
    return F.struct(*(F.greatest(none, v).cast("long").alias(k) for k, v in sides.items()))


def mask_window(start: Column, length: Column, slide: int | Column, mask: int) -> tuple[Column, Column, Column]:
    """First and last cell (half-open, clamped) of a span in a mask along one side, and its unclamped length in cells."""
    low = F.floor(start / slide * mask)
    high = F.ceil((start + length) / slide * mask)
    first = F.greatest(F.lit(0), F.least(F.lit(mask), low))
    last = F.greatest(first, F.least(F.lit(mask), high))
    return first.cast("long"), last.cast("long"), F.greatest(F.lit(1), high - low).cast("long")
