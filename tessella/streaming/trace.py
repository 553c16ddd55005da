"""Logs of calls: pairing, documents per trace, costs; as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "run_id string, trace_id string, event_id int, ts timestamp, call_id string, phase string, component string, operation string, step_id int, "
    "attempt int, status string, error string, request string, response string, payload string"
)
#: Keys that no trace may hold.
BLIND = ("ground_truth", "gold_answer", "source_report_evidence", "结构化金标")


def pair_calls(events: DataFrame, by: list[str], call: str = "call_id", phase: str = "phase", ts: str = "ts") -> DataFrame:
    """One row per call: when it began and ended, its latency in milliseconds, and whether it ended."""
    when = lambda p, f: f(F.when(F.col(phase) == p, F.col(ts)))
    out = events.where(F.col(phase).isin("before", "after")).groupBy(*by, call).agg(when("before", F.min).alias("began"), when("after", F.max).alias("ended"))
    out = out.where("began is not null")
    return out.withColumn("latency_ms", F.timestamp_diff("MILLISECOND", "began", "ended")).withColumn("finished", F.col("ended").isNotNull())


def numbered(events: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    return events.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def documents(events: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per trace: its events in order as JSON, and their number."""
    item = F.struct(order, *fields)
    listed = events.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("events"))
    return listed.withColumn("n_events", F.size("events")).withColumn("document", F.to_json("events"))


#: Folders that events and results are dealt to.
BUCKETS = 64


def bucketed(rows: DataFrame, by: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))


def append(events: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append events, in a bounded number of folders by a hash of the trace."""
    bucketed(events, "trace_id", buckets).write.mode("append").partitionBy("bucket").json(path)


def append_once(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A stream of events written to a log in which every event stands once.

    Each micro-batch goes to a folder of its own number, which is replaced as a
    whole: a batch that is run again after a crash writes the same events to the
    same place.  ``read_log`` reads only whole folders, since Spark marks them as
    committed when all of their files are in place.
    """

    def put(batch: DataFrame, number: int) -> None:
        bucketed(batch, "trace_id", buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """The events of a log that ``append_once`` writes, from its committed batches alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("batch=")] if fs.exists(root) else []
    whole = [str(f) for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*whole).drop("batch", "bucket")


def rotate(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Move an unfinished log out of the way, as a whole; its new place, or None if there is none.

    A log is one folder, and a folder is renamed in one step.  A place that is
    taken already is not overwritten.
    """
    jvm = spark.sparkContext._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.interrupted-{stamp}")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return None
    if fs.exists(there) or not fs.rename(here, there):
        raise ValueError(f"{there} is there already")
    return str(there)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from a folder of JSON lines."""
    return spark.readStream.schema(EVENT).json(path)


def stream_calls(events: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Calls with their latency from a stream of events; a call that has not ended within ``longest`` comes without an end."""
    held = events.withWatermark("ts", late)
    before = held.where("phase = 'before'").select(F.col("call_id"), "trace_id", F.col("ts").alias("began"))
    after = held.where("phase = 'after'").select(F.col("call_id").alias("of"), F.col("ts").alias("ended"), "status")
    same = F.expr(f"call_id = of AND ended >= began AND ended <= began + interval {longest}")
    return before.join(after, same, "left_outer").withColumn("latency_ms", F.timestamp_diff("MILLISECOND", "began", "ended")).drop("of")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each trace: events no further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy("trace_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n_events"))


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
