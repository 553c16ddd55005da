"""Fractions over tables of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A white pixel is at least so bright and at most so saturated, of 255.
BRIGHT, SATURATED = 240, 15


def is_white(red: Column, green: Column, blue: Column) -> Column:
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    saturation = F.when(high > 0, F.floor((high - low) * 255.0 / high)).otherwise(0)
    return ((red + green + blue) / 3.0 >= BRIGHT) & (saturation <= SATURATED)


def white_fraction(red: Column, green: Column, blue: Column) -> Column:
    """An aggregate: the share of white pixels."""
    return F.avg(is_white(red, green, blue).cast("double"))


def over_white(value: Column, alpha: Column) -> Column:
    """A channel laid over white."""
    return F.round(value * alpha / 255.0 + 255.0 * (1 - alpha / 255.0)).cast("int")
