"""Texts put together from descriptions, within limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_join(rows: DataFrame, by: list[str], order: list, text: Column, separator: str, name: str) -> DataFrame:
    """The texts of each group in order, as one; a group is what one question sees."""
    item = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order), text.alias("__t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__t"]), separator)
    return rows.groupBy(*by).agg(joined.alias(name), F.count("*").alias("n"))


def tile_line(id: Column, x: Column, y: Column, magnification: Column, width_um: Column, height_um: Column, text: Column) -> Column:
    """A description after its tile's place, magnification and field of view."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    size = F.format_string("%.1fx%.1fum", width_um.cast("double"), height_um.cast("double"))
    view = F.when(width_um.isNotNull() & height_um.isNotNull(), size).otherwise("unknown")
    place = F.concat(F.lit(" | Level0=("), number(x), F.lit(","), number(y), F.lit(") | Magnification="), magnification.cast("string"))
    return F.concat(F.lit("["), id, place, F.lit("x | FOV="), view, F.lit("] "), text)


def within(text: Column, limit: int) -> Column:
    """Whether a text is within the limit; texts are never cut."""
    return F.length(text) <= limit


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int = 5, threshold: int = 50) -> DataFrame:
    """``rows`` with ``chunk``: numbers of consecutive chunks from 0 in groups of more than ``threshold``, else 0."""
    window = Window.partitionBy(*by)
    number = F.floor((F.row_number().over(window.orderBy(*order)) - 1) / size)
    return rows.withColumn("chunk", F.when(F.count("*").over(window) > threshold, number).otherwise(0))


def described(ids: Column, texts: Column) -> Column:
    """Ids with a text that is not blank, in order of their first appearance; ``texts`` maps ids to texts."""
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(F.trim(F.try_element_at(texts, i)) != "", F.lit(False))))
