"""Rectangular regions: children, overlaps, and how much of a mask they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import cut
from tessella.functions.geometry import mask_window, overlaps, rectangle

SOURCE_MAGNIFICATION = 5
MAGNIFICATIONS = (10, 20)


def children(regions: DataFrame, target: int) -> DataFrame:
    """The (target / 5) squared children of each region (slide_id, patch_id, x, y, w, h); they tile it exactly."""
    if target not in MAGNIFICATIONS:
        raise ValueError(f"magnification {target} is not one of {MAGNIFICATIONS}")
    f = target // SOURCE_MAGNIFICATION
    steps = F.sequence(F.lit(0), F.lit(f - 1))
    grid = regions.withColumn("row", F.explode(steps)).withColumn("col", F.explode(steps))
    edge = lambda start, length, i: F.col(start) + F.floor((i * F.col(length)) / F.lit(f))
    for start, length, i in (("x", "w", "col"), ("y", "h", "row")):
        grid = grid.withColumn(f"{start}0", edge(start, length, F.col(i))).withColumn(f"{start}1", edge(start, length, F.col(i) + 1))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    name = F.concat(F.lit("x"), "x0", F.lit("_y"), "y0", F.lit("_w"), w, F.lit("_h"), h, F.lit(f"_m{target}"))
    return grid.select("slide_id", name.alias("patch_id"), F.col("patch_id").alias("parent_patch_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), w.alias("w"), h.alias("h"), F.lit(target).alias("magnification"))


def split_tiles(tiles: DataFrame, factor: int) -> DataFrame:
    """Tiles (patch_id, x, y, w, h) cut ``factor`` times each way; the last row and column take what is left over."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    grid = tiles.withColumn("row", F.explode(steps)).withColumn("col", F.explode(steps))
    for start, length, i in (("x", "w", "col"), ("y", "h", "row")):
        part = F.floor(F.col(length) / factor)
        last = F.when(F.col(i) == factor - 1, F.col(length) - part * (factor - 1)).otherwise(part)
        grid = grid.withColumn(f"{start}_", F.col(start) + part * F.col(i)).withColumn(f"{length}_", last)
    return grid.select("patch_id", "row", "col", F.col("x_").alias("x"), F.col("y_").alias("y"), F.col("w_").alias("w"), F.col("h_").alias("h"))


def overlapping_pairs(regions: DataFrame, by: list[str], id: str, cell: int) -> DataFrame:
    """Pairs (a, b) of regions of a group that share area, a before b.

    Each region goes into the grid cells that it touches and meets only the
    regions of its cells; a pair is kept in the first cell that both touch.
    """
    span = lambda start, length: F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.greatest(F.col(length) - 1, F.lit(0))) / cell))
    placed = regions.withColumn("gx", F.explode(span("x", "w"))).withColumn("gy", F.explode(span("y", "h")))
    side = lambda s: placed.select(*by, "gx", "gy", F.struct(F.col(id).alias("id"), "x", "y", "w", "h").alias(s))
    pairs = side("a").join(side("b"), [*by, "gx", "gy"]).where(F.col("a.id") < F.col("b.id"))
    a, b = rectangle(F.col("a")), rectangle(F.col("b"))
    first = (F.col("gx") == F.floor(F.greatest(a["x"], b["x"]) / cell)) & (F.col("gy") == F.floor(F.greatest(a["y"], b["y"]) / cell))
    return pairs.where(first & overlaps(a, b)).select(*by, F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def greedy_nonoverlap(candidates: DataFrame, by: list[str], order: list[Column], id: str, most: int = 4, apart: str | None = None) -> DataFrame:
    """``candidates`` (``by``, x, y, w, h and others) that are taken, with ``position`` from 1.

    Each group's candidates are taken in ``order``, and by ``id`` if that ties,
    unless they overlap one taken before, up to ``most``; where the column
    ``apart`` is false, overlaps do not matter.  Candidates are gone through in
    rounds, and no group is ever held in one row or task: a round takes the first
    candidate of every group, which is counted up before the shuffle, and drops
    what overlaps it.  What is first has been overlapped by nothing taken before,
    so ``most`` rounds give the same as going through a group one by one.
    """
    rank, columns = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(id).alias("id")), candidates.columns
    left, taken = cut(candidates.withColumn("rank_", rank)), []
    for position in range(1, most + 1):
        first = left.groupBy(*by).agg(F.min_by(F.struct(*columns, "rank_"), "rank_").alias("first"))
        taken.append(first.select(*(F.col(f"first.{c}").alias(c) for c in columns), F.lit(position).alias("position")))
        if position == most:
            break
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in by))
        blocked = overlaps(rectangle(F.struct("x", "y", "w", "h")), rectangle(F.col("first")))
        blocked = blocked if apart is None else F.col(apart) & blocked
        left = cut(left.join(first.select("first"), same).where((F.col("rank_") > F.col("first.rank_")) & ~blocked).drop("first"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken)


def summed_area(cells: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """``total`` for each corner (i, j), 0 to ``width`` and ``height``: the sum of ``value`` over cells left of and above it."""
    corners = cells.select(*by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(height))))
    held = cells.groupBy(*by, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")).agg(F.sum("value").alias("value"))
    full = corners.join(held, [*by, "i", "j"], "left").na.fill(0, ["value"])
    rows = full.withColumn("row", F.sum("value").over(Window.partitionBy(*by, "j").orderBy("i")))
    return rows.withColumn("total", F.sum("row").over(Window.partitionBy(*by, "i").orderBy("j"))).select(*by, "i", "j", "total")


def mask_fraction(regions: DataFrame, corners: DataFrame, by: list[str], slide_width: int, slide_height: int, width: int, height: int) -> DataFrame:
    """``regions`` with ``fraction``: the mask's sum inside each over its unclipped area, by four corner look-ups."""
    left, right, across = mask_window(F.col("x"), F.col("w"), slide_width, width)
    top, bottom, down = mask_window(F.col("y"), F.col("h"), slide_height, height)
    out = regions.withColumns({"l_": left, "r_": right, "t_": top, "b_": bottom, "area_": across * down})
    for name, i, j in (("s1", "r_", "b_"), ("s2", "l_", "b_"), ("s3", "r_", "t_"), ("s4", "l_", "t_")):
        corner = corners.select(*by, F.col("i").alias(i), F.col("j").alias(j), F.col("total").alias(name))
        out = out.join(corner, [*by, i, j], "left")
    total = F.coalesce("s1", F.lit(0)) - F.coalesce("s2", F.lit(0)) - F.coalesce("s3", F.lit(0)) + F.coalesce("s4", F.lit(0))
    return out.withColumn("fraction", total / F.col("area_")).drop("l_", "r_", "t_", "b_", "area_", "s1", "s2", "s3", "s4")
