"""Calls to something outside, in partitions: budgets before, retries around, a cache beside."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import cut
from tessella.functions.policy import call_cost
from tessella.operators.history import numbered_rows

# Characters of a request, and status codes that may be asked again besides 5xx.
MOST_CHARS, AGAIN = 120_000, (429,)
REPLY = "status int, reply string, prompt_tokens long, hit_tokens long, miss_tokens long, completion_tokens long, attempts int"


def cache_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "cache_key", reply: str = "reply") -> DataFrame:
    """``requests`` with ``cached``, the known reply or null.  ``cache`` may hold a key more than once; any row will do."""
    known = cache.groupBy(key).agg(F.any_value(reply).alias("cached"))
    return requests.join(known, key, "left")


def new_entries(replies: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Replies to append to the cache."""
    return replies.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def append_description(before: Column, more: Column) -> Column:
    """A description grows by what is said next."""
    return F.trim(F.concat_ws(" ", F.coalesce(before, F.lit("")), more))


def call(requests: DataFrame, send: Callable[[str], dict], key: str, request: str, attempts: int = 3, backoff: float = 1.0, most_chars: int = MOST_CHARS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``requests`` (key, request) answered by ``send``, one row for each.

    A request over ``most_chars`` is not sent (status 413).  Network errors and
    responses of no known shape (an ``OSError`` or ``ValueError``; status null), 429, 5xx and empty replies are asked again after
    ``backoff`` times powers of two.  What ``send`` returns has status, reply and
    token counts.
    """
    kind = dict(requests.dtypes)[key]

    def one(text: str) -> dict:
        if len(text) > most_chars:
            return {"status": 413, "attempts": 0}
        for n in range(1, attempts + 1):
            try:
                got = {**send(text), "attempts": n}
            except (OSError, ValueError):  # no connection, or a response of no known shape
                got = {"status": None, "attempts": n}
            status = got.get("status")
            again = status is None or status in AGAIN or status >= 500 or status == 200 and not got.get("reply")
            if not again or n == attempts:
                return got
            sleep(backoff * 2 ** (n - 1))
        return {}

    names = [x.split()[0] for x in REPLY.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(t) for t in part[request]]
            out = pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)
            yield pd.concat([part[[key]].reset_index(drop=True), out.astype({n: "Int64" for n in names if n != "reply"})], axis=1)

    return requests.select(key, request).mapInPandas(run, f"{key} {kind}, {REPLY}")


def within_budget(calls: DataFrame, by: list[str], order: list[str], budget: float) -> DataFrame:
    """``calls`` (token counts) with cost, total and whether the next call may be made."""
    from tessella.operators.history import running_sum

    cost = call_cost(F.col("prompt_tokens"), F.col("hit_tokens"), F.col("miss_tokens"), F.col("completion_tokens"))
    out = running_sum(calls.withColumn("cost", cost), by, order, F.col("cost"), "total")
    return out.withColumn("may_go_on", F.col("total") < budget)


# Failures in a row, and the share of all that is expected, that stop a batch.
MOST_IN_A_ROW, MOST_SHARE = 2, 0.05
#: Statuses of requests that were not sent: no money left, or too many failures before.
UNPAID, STOPPED = 402, 503
#: Requests of the first wave.
FIRST_WAVE = 16


@dataclass
class Meter:
    """What calls have cost and how they have failed, and whether more may be sent.

    ``expected`` is the number of calls or rollouts that the share of failures
    counts in; without it failures stop nothing.
    """

    budget: float = float("inf")
    expected: int | None = None
    most_in_a_row: int = MOST_IN_A_ROW
    most_share: float = MOST_SHARE
    spent: float = 0.0
    sent: int = 0
    failures: int = 0
    in_a_row: int = 0

    def refuses(self) -> int | None:
        """The status of what is not sent any more, or None."""
        if self.expected is not None and (self.in_a_row >= self.most_in_a_row or self.failures > self.most_share * max(1, self.expected)):
            return STOPPED
        return UNPAID if self.spent >= self.budget else None

    def affordable(self, wanted: int) -> int:
        """How many of ``wanted`` requests the rest of the budget pays for at the mean cost so far; one at least."""
        if not self.sent or not self.spent or self.budget == float("inf"):
            return wanted
        return max(1, min(wanted, int((self.budget - self.spent) * self.sent / self.spent)))

    def count(self, sent: DataFrame) -> None:
        """Take in a wave (number and what came back), its numbers following those before."""
        bad = F.coalesce(F.col("status") != 200, F.lit(True))
        cost = call_cost(F.col("prompt_tokens"), F.col("hit_tokens"), F.col("miss_tokens"), F.col("completion_tokens"))
        told = sent.agg(F.count("*").alias("n"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.count_if(bad).alias("failures"), F.min("number").alias("first"), F.max("number").alias("last")).first()
        # The failures of one wave, whose size is bounded: runs are numbers that follow each other.
        failed = sent.where(bad).withColumn("run", F.col("number") - F.row_number().over(Window.orderBy("number")))
        runs = [(r["low"], r["n"]) for r in failed.groupBy("run").agg(F.min("number").alias("low"), F.count("*").alias("n")).collect()] if told["failures"] else []
        joined = [n + (self.in_a_row if low == told["first"] else 0) for low, n in runs]
        longest, ending = max(joined, default=0), next((n for n, (low, own) in zip(joined, runs) if low + own - 1 == told["last"]), 0)
        self.spent, self.sent, self.failures = self.spent + told["cost"], self.sent + told["n"], self.failures + told["failures"]
        self.in_a_row = longest if longest >= self.most_in_a_row else ending


#: The most requests of a wave.
MOST_WAVE = 100_000


def call_in_waves(requests: DataFrame, send: Callable[[str], dict], key: str, request: str, meter: Meter, first_wave: int = FIRST_WAVE, **options) -> DataFrame:
    """``call`` in the order of the key, wave by wave, as long as ``meter`` allows; what is not sent has no attempts and the status that says why.

    A wave has at most twice as many requests as the one before, and no more than
    the budget pays for at the mean cost so far.
    """
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in REPLY.split(", ")}
    held = cut(numbered_rows(requests.select(key, request), [key], "number"))
    n, at, size, done = held.count(), 0, meter.affordable(first_wave), held.limit(0).select(key, *(c.alias(k) for k, c in nothing.items()))
    while at < n:
        status = meter.refuses()
        if status is not None:
            left = {**nothing, "status": F.lit(status), "attempts": F.lit(0)}
            return done.unionByName(held.where(F.col("number") > at).select(key, *(c.alias(k) for k, c in left.items())))
        wave = held.where((F.col("number") > at) & (F.col("number") <= at + size))
        out = cut(call(wave, send, key, request, **options).join(wave.select(key, "number"), key))
        meter.count(out)
        done, at = done.unionByName(out.drop("number")), min(n, at + size)
        size = meter.affordable(min(2 * size, MOST_WAVE))
    return done


def call_within(requests: DataFrame, send: Callable[[str], dict], key: str, request: str, budget: float, spent: float = 0.0, **options) -> DataFrame:
    """``call_in_waves`` until ``budget`` is spent, ``spent`` of it before."""
    return call_in_waves(requests, send, key, request, Meter(budget, spent=spent), **options)


def require_one_model(calls: DataFrame, by: list[str], model: str) -> DataFrame:
    """``calls`` itself, after a look at its models; a group that more than one model answered is an error."""
    found = drifted(calls, by, model).take(1)
    if found:
        raise ValueError(f"more than one model answered {found[0].asDict()}")
    return calls


def drifted(calls: DataFrame, by: list[str], model: str) -> DataFrame:
    """Groups that more than one model answered."""
    return calls.groupBy(*by).agg(F.array_sort(F.collect_set(model)).alias("models")).where(F.size("models") > 1)
