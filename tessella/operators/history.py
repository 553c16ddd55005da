"""What happened before: runs, the best so far, running costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import cut


def numbered_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their numbers from 1 in ``order``, without bringing them into one task: ranges are sorted, and counted one after another."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    shift = sizes.select("part_", (before - F.col("first_") + 1).alias("shift_"))
    return placed.withColumn("part_", part).join(F.broadcast(shift), "part_").withColumn(name, F.col("at_") + F.col("shift_")).drop("at_", "part_", "shift_")


def run_length(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """How many rows in a row up to each have had its value."""
    over = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(over)) | (F.row_number().over(over) == 1)).cast("int"), F.lit(1))
    marked = rows.withColumn("__change", changed).withColumn("__run", F.sum("__change").over(over))
    return marked.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__run").orderBy(*order))).drop("__change", "__run")


def best_so_far(rows: DataFrame, by: list[str], order: list[str], rank: list[Column], keep: list[str], name: str) -> DataFrame:
    """After each row, the row with the largest ``rank`` up to there; of equal ones the first."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    placed = rows.withColumn("__place", -place)
    best = F.max_by(F.struct(*keep), F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)), F.col("__place"))).over(window)
    return placed.withColumn(name, best).drop("__place")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(value).over(window))


def failure_gate(rows: DataFrame, by: list[str], order: list[str], failed: str, most_in_a_row: int = 2, most_share: float = 0.05) -> DataFrame:
    """With ``in_a_row``, ``failures``, ``share`` and ``stop``: whether a batch should have stopped after this row."""
    runs = run_length(rows, by, order, failed, "__n")
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = runs.withColumn("in_a_row", F.when(F.col(failed), F.col("__n")).otherwise(0)).drop("__n")
    out = out.withColumn("failures", F.sum(F.col(failed).cast("long")).over(window))
    out = out.withColumn("share", F.col("failures") / F.count(F.lit(1)).over(window))
    return out.withColumn("stop", F.col(failed) & ((F.col("in_a_row") >= most_in_a_row) | (F.col("share") > most_share)))
