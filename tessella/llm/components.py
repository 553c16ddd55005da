"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import MAX_BROADCAST_ROWS, drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node with an edge; the root is the smallest node of its component.

    ``edges`` may repeat, run either way and hold loops; rows with a null end
    are no edges, and a node with loops only has no row.  Each round links every
    node's larger neighbours, then its smaller ones, to the smallest; the edges
    only ever move, so a component of n nodes never needs more than its own
    edges, and the rounds grow as the logarithm of n squared at worst.  Minima
    are aggregated before they are shuffled, and joins read written tables, so a
    node with very many edges may be split.  While there are few edges, the minima
    are broadcast.
    """
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = materialize(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        sent = F.broadcast if state[0] <= MAX_BROADCAST_ROWS else lambda df: df
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large")
        large = both.where("b > a").join(sent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "edges")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(sent(low), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m").toDF("a", "b"))
        after = materialize(small.distinct(), "edges")
        new = _state(after)
        for old in (now, least, large, low):
            drop(old)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
