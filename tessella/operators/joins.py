"""Joins that a catalogue of slides, tiles and questions needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_prefix(keys: DataFrame, catalogue: DataFrame, key: str, name: str, shortest: int) -> DataFrame:
    """``keys`` with ``resolved``: the smallest catalogue name that begins with the key, or else the key itself.

    Keys have at least ``shortest`` characters.  For each length that keys have, the
    smallest name of every beginning of that length is found once, in a sum by
    beginning, so names are never met with keys one by one; the work is the
    catalogue times the number of different lengths.
    """
    asked = keys.select(F.col(key).alias("__head")).where(F.length(key) >= shortest).distinct()
    lengths = asked.agg(F.collect_set(F.length("__head")).alias("__lengths"))  # one short row
    heads = catalogue.select(F.col(name).alias("__name")).join(F.broadcast(lengths)).withColumn("__length", F.explode(F.filter("__lengths", lambda n: n <= F.length("__name"))))
    least = heads.groupBy(F.expr("substring(__name, 1, __length)").alias("__head")).agg(F.min("__name").alias("__least"))
    found = least.join(asked, "__head", "left_semi").withColumnRenamed("__head", key)
    return keys.join(found, key, "left").withColumn("resolved", F.coalesce("__least", F.col(key))).drop("__least")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with ``side`` left or right; empty if the sets are equal."""
    sides = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1)))
    found = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return found.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of either side, each once."""
    return a.select(key).union(b.select(key)).distinct()


def available(features: DataFrame, descriptions: DataFrame, on: list[str]) -> DataFrame:
    """The features whose tile is described."""
    return features.join(descriptions.select(*on).distinct(), on, "left_semi")


def clean(status: Column, contract_pass: Column, safety_pass: Column, fallback: Column) -> Column:
    """Whether a description may be evidence; what is not known counts against it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(status == "success") & yes(contract_pass) & yes(safety_pass) & ~F.coalesce(fallback, F.lit(True))


def with_flag(rows: DataFrame, flagged: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether their key is in ``flagged``.  ``flagged`` is reduced to its keys, so rows never multiply."""
    keys = flagged.select(*on).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
