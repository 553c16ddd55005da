"""Choosing sub-regions to look at closer: class, risk, gate and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the classes, the ranges over which the risk rises, and its weight.
BLANK_TISSUE, BLANK_WHITE = 0.01, 0.98
SOUND_TISSUE, SOUND_WHITE = 0.05, 0.95
TISSUE_RANGE, WHITE_RANGE = 0.04, 0.03
PENALTY = 0.05


def candidate_class(tissue: Column, white: Column) -> Column:
    blank = (tissue < BLANK_TISSUE) & (white >= BLANK_WHITE)
    sound = (tissue >= SOUND_TISSUE) & (white < SOUND_WHITE)
    return F.when(blank, "strict_blank").when(sound, "definite_nonblank").otherwise("ambiguous")


def ambiguous_risk(tissue: Column, white: Column, kind: Column) -> Column:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    risk = F.greatest(clip((SOUND_TISSUE - tissue) / TISSUE_RANGE), clip((white - SOUND_WHITE) / WHITE_RANGE))
    return F.when(kind == "ambiguous", risk).otherwise(0.0)


def rank_candidates(candidates: DataFrame, by: list[str], index: str = "index", top_k: int = 2) -> DataFrame:
    """``candidates`` (kind, tissue, white, padding map, score) with reasons, risk, adjusted score, rank and whether chosen.

    Blank and padded candidates are out.  The others are ranked by adjusted
    score, then score, then the smaller ``index``.
    """
    if top_k < 1:
        raise ValueError("top_k has to be at least 1")
    padded = F.exists(F.map_values(F.coalesce("padding", F.create_map().cast("map<string,bigint>"))), lambda v: v > 0)
    reasons = F.filter(F.array(F.when(F.col("kind") == "strict_blank", "strict_blank"), F.when(padded, "padding")), lambda x: x.isNotNull())
    out = candidates.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    out = out.withColumn("risk", ambiguous_risk(F.col("tissue"), F.col("white"), F.col("kind")))
    out = out.withColumn("adjusted", F.col("score") - PENALTY * F.col("risk"))
    order = Window.partitionBy(*by, "eligible").orderBy(F.desc("adjusted"), F.desc("score"), index)
    out = out.withColumn("eligible_rank", F.when(F.col("eligible"), F.row_number().over(order)))
    return out.withColumn("chosen", F.coalesce(F.col("eligible_rank") <= top_k, F.lit(False)))
