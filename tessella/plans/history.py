"""Queries on event logs: order, runs, costs, calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.checkpoints import shared_folder
from tessella.functions.policy import call_cost
from tessella.operators import history
from tessella.plans.registry import query, table
from tessella.streaming import gate, trace

_ORDER = ["ts", "event_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), min(event_id)) AS r FROM events GROUP BY user_id, event_type)
    SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS types FROM f GROUP BY user_id""")
def ordered_distinct(spark, sf_dir):
    """Each user's kinds of events in order of their first appearance, by way of the first of each kind."""
    first = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct(*_ORDER)).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(listed, ",").alias("types"))


@query("""WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS ch FROM events),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS stability FROM r""")
def candidate_stability(spark, sf_dir):
    out = history.run_length(_events(spark, sf_dir), ["user_id"], _ORDER, "event_type", "stability")
    return out.select("event_id", F.col("stability").cast("long").alias("stability"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY n) AS best_value FROM p)
    SELECT m.event_id, m.best_value, (SELECT min(n) FROM p WHERE p.user_id = m.user_id AND p.value = m.best_value) AS best_place FROM m""")
def best_so_far(spark, sf_dir):
    e = trace.numbered(_events(spark, sf_dir), ["user_id"], _ORDER, "n")
    out = history.best_so_far(e, ["user_id"], ["n"], [F.col("value")], ["value", "n"], "best")
    return out.select("event_id", F.col("best.value").alias("best_value"), F.col("best.n").cast("long").alias("best_place"))


@query("""WITH p AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    g AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY n) AS ok, sum(bad::INT) OVER (PARTITION BY user_id ORDER BY n) AS failures FROM p),
    r AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, ok, bad ORDER BY n) ELSE 0 END AS in_a_row FROM g)
    SELECT event_id, in_a_row, failures::BIGINT AS failures, bad AND (in_a_row >= 2 OR failures / n > 0.05) AS stop FROM r""")
def failure_runs(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    out = history.failure_gate(e, ["user_id"], _ORDER, "bad")
    return out.select("event_id", F.col("in_a_row").cast("long").alias("in_a_row"), "failures", "stop")


_TOKENS = "event_id % 1000 AS prompt, event_id % 400 AS hit, CASE WHEN event_id % 3 = 0 THEN event_id % 600 END AS miss, event_id % 100 AS completion"


@query(f"""WITH t AS (SELECT *, {_TOKENS} FROM events), c AS (SELECT *, (hit * 0.02::DOUBLE + coalesce(miss, greatest(0, prompt - hit)) * 1.0::DOUBLE + completion * 2.0::DOUBLE) / 1000000 AS cost FROM t)
    SELECT event_id, round(cost, 9) AS cost, round(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id), 8) AS total FROM c""")
def cumulative_cost(spark, sf_dir):
    i = F.col("event_id")
    cost = call_cost(i % 1000, i % 400, F.when(i % 3 == 0, i % 600), i % 100)
    e = history.running_sum(_events(spark, sf_dir).withColumn("cost", cost), ["user_id"], _ORDER, F.col("cost"), "total")
    return e.select("event_id", F.round("cost", 9).alias("cost"), F.round("total", 8).alias("total"))


@query("""WITH c AS (SELECT user_id, event_id // 2 AS call_id, min(ts) FILTER (event_id % 2 = 0) AS b, max(ts) FILTER (event_id % 2 = 1 AND event_type <> 'error') AS a FROM (SELECT * REPLACE (event_id // 2 AS user_id) FROM events) GROUP BY ALL)
    SELECT call_id, trunc((epoch_us(a) - epoch_us(b)) / 1000)::BIGINT AS latency_ms, a IS NOT NULL AS finished FROM (SELECT call_id, b, a FROM c WHERE b IS NOT NULL)""")
def call_pairing(spark, sf_dir):
    """Even events begin calls and the odd ones after them end them, but errors."""
    e = _events(spark, sf_dir).withColumn("call_id", F.floor(F.col("event_id") / 2))
    phase = F.when(F.col("event_id") % 2 == 0, "before").when(F.col("event_type") != "error", "after")
    return trace.pair_calls(e.withColumn("phase", phase), []).select("call_id", "latency_ms", "finished")


@query("""SELECT user_id, count(*) AS n_events, md5('[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']') AS digest FROM events GROUP BY user_id""")
def trace_documents(spark, sf_dir):
    out = trace.documents(_events(spark, sf_dir), ["user_id"], "event_id", ["event_type"])
    return out.select("user_id", F.col("n_events").cast("long").alias("n_events"), F.md5(F.col("document").cast("binary")).alias("digest"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def props_json(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _drained(spark, events, of, name):
    """What a stream over ``events``, written for it, gives until all of them are read."""
    held = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    events.write.parquet(f"{held}/in")
    stream = of(spark.readStream.schema(events.schema).parquet(f"{held}/in"))
    trace.write_stream(stream, f"{held}/out", f"{held}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{held}/out")


@query("""WITH p AS (SELECT *, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    g AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY n) AS ok, sum(bad::INT) OVER (PARTITION BY user_id ORDER BY n) AS failures, min(event_type) OVER w <> max(event_type) OVER w AS drifted FROM p WINDOW w AS (PARTITION BY user_id ORDER BY n)),
    r AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, ok, bad ORDER BY n) ELSE 0 END AS in_a_row FROM g),
    s AS (SELECT *, bad AND (in_a_row >= 2 OR failures / n > 0.05) AS stop FROM r)
    SELECT event_id, in_a_row, failures::BIGINT AS failures, drifted, stop, bool_or(stop) OVER (PARTITION BY user_id ORDER BY n) AS stopped FROM s""")
def failure_stream(spark, sf_dir):
    """The failure gate over the events as a stream, a user for a batch and the kind of event for a model."""
    e = _events(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    out = _drained(spark, e, lambda s: gate.watched(s, "user_id", _ORDER, "bad", "event_type", "event_id"), "failures")
    return out.select("event_id", "in_a_row", "failures", "drifted", "stop", "stopped")
