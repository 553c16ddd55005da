"""Vectors held as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector.

    The length is bound to a name, as an entry of an array: as an expression it
    would be worked out again for every component.
    """
    return F.transform(F.array(norm(a)), lambda length: F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)))[0]
