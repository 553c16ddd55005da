"""Small scalar rules: how much to retrieve, what a call costs, how to sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the available tiles taken first and by each
# replenishment, and prices in RMB per million tokens.
INITIAL_RATIO, REPLENISH_RATIO = 0.10, 0.05
PRICE_CACHE_HIT, PRICE_CACHE_MISS, PRICE_COMPLETION = 0.02, 1.0, 2.0


def retrieval_count(available: Column, ratio: float, top_k: int | None = None) -> Column:
    """How many to take of ``available``: none of none, else ``top_k`` at most, else the truncated share, at least 1."""
    if top_k is not None:
        if top_k < 1:
            raise ValueError("top_k has to be at least 1")
        return F.greatest(F.lit(0), F.least(available, F.lit(top_k))).cast("long")
    share = F.greatest(F.lit(1), (available * F.lit(float(ratio))).cast("long"))
    return F.when(available < 1, F.lit(0)).otherwise(share).cast("long")


def call_cost(prompt: Column, hit: Column, miss: Column, completion: Column) -> Column:
    """The price of a call; without a count of missed tokens it is what the prompt has beyond the hits."""
    zero = F.lit(0)
    missed = F.coalesce(miss, F.greatest(zero, F.coalesce(prompt, zero) - F.coalesce(hit, zero)))
    total = F.coalesce(hit, zero) * PRICE_CACHE_HIT + missed * PRICE_CACHE_MISS + F.coalesce(completion, zero) * PRICE_COMPLETION
    return total / 1_000_000.0


def sampling(rollout: Column, temperature: float = 0.7, top_p: float = 0.95, seed: int = 0) -> Column:
    """Rollout 0 is deterministic; each other one has its own seed."""
    first = rollout == 0
    return F.struct(
        F.when(first, 0.0).otherwise(temperature).alias("temperature"),
        F.when(first, 1.0).otherwise(top_p).alias("top_p"),
        (F.lit(seed) + rollout).cast("long").alias("seed"),
    )


def retry_delay(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before the attempt after ``attempt`` (from 1)."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def retryable(status: Column, empty: Column) -> Column:
    """Whether a response may be asked for again: network errors (null), 429, 5xx, and empty answers."""
    return status.isNull() | (status == 429) | (status >= 500) | ((status == 200) & empty)
