"""Watching a stream of calls: failures in a row, their share, and the models that answered, for each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.calls import MOST_IN_A_ROW, MOST_SHARE

#: What is held of a batch: calls, failures, failures in a row, models seen, and whether it has been stopped.
STATE = "n long, failures long, in_a_row long, models array<string>, stopped boolean"


def watched(events: DataFrame, by: str, order: list[str], failed: str, model: str, id: str, most_in_a_row: int = MOST_IN_A_ROW, most_share: float = MOST_SHARE, expected: int | None = None) -> DataFrame:
    """Rows (by, id, in_a_row, failures, share, drifted, stop, stopped) for every event of a stream.

    ``stop`` says that a batch should stop after this call, as in
    ``history.failure_gate``; ``stopped`` that it should have by then.  ``share``
    counts in the calls so far, or in the ``expected`` ones; ``drifted`` is whether
    more than one model has answered.  The events of a micro-batch are taken in
    ``order``; what comes in a later one follows.  State is five fields for each
    batch, however many calls it makes.
    """
    kinds = dict(events.dtypes)
    schema = f"{by} {kinds[by]}, {id} {kinds[id]}, in_a_row long, failures long, share double, drifted boolean, stop boolean, stopped boolean"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failures, in_a_row, models, stopped = state.get if state.exists else (0, 0, 0, [], False)
        models, out = list(models), []
        for event in pd.concat(list(parts)).sort_values(order, kind="stable").itertuples(index=False):
            bad = bool(getattr(event, failed))
            n, failures, in_a_row = n + 1, failures + bad, in_a_row + 1 if bad else 0
            answered = getattr(event, model)
            if isinstance(answered, str) and answered not in models[:2]:
                models = [*models, answered][:2]  # two are enough to tell
            share = failures / (expected or n)
            stop = bad and (in_a_row >= most_in_a_row or share > most_share)
            stopped = stopped or stop
            out.append((key[0], getattr(event, id), in_a_row, failures, share, len(models) > 1, stop, stopped))
        state.update((n, failures, in_a_row, models, stopped))
        yield pd.DataFrame(out, columns=[by, id, "in_a_row", "failures", "share", "drifted", "stop", "stopped"])

    needed = events.select(by, id, *(c for c in dict.fromkeys([*order, failed, model]) if c not in (by, id)))
    return needed.groupBy(by).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def may_send(requests: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """The ``requests`` of batches that nothing has stopped, by the ``verdicts`` that ``watched`` has given so far."""
    stopped = verdicts.where("stopped").select(by).distinct()
    return requests.join(stopped, by, "left_anti")


def models_of(verdicts: DataFrame, by: str) -> DataFrame:
    """Rows (by, drifted): whether more than one model has answered a batch."""
    return verdicts.groupBy(by).agg(F.max("drifted").alias("drifted"))
