"""Runs: manifests that must not change, results that are not overwritten, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.guards import forbidden_keys
from tessella.streaming.trace import BLIND, BUCKETS, bucketed, documents


def manifest_hash(manifest: DataFrame) -> str:
    """The SHA-256 of a one-row manifest as JSON with sorted columns."""
    return manifest.select(F.sha2(F.to_json(F.struct(*sorted(manifest.columns))), 256)).first()[0]


def write_or_verify(manifest: DataFrame, path: str) -> None:
    """Write a run's manifest, or check that the one there is the same; another one is an error."""
    spark = manifest.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if manifest_hash(spark.read.schema(manifest.schema).json(path)) != manifest_hash(manifest):
            raise ValueError(f"{path} holds the manifest of another run")
    else:
        manifest.write.json(path)


def finalize(events: DataFrame, path: str) -> None:
    """Write one document per trace; traces that hold a forbidden key, or are there already, are errors."""
    fields = [c for c in events.columns if c not in ("trace_id", "event_id")]
    texts = [c for c, kind in events.dtypes if kind == "string" and c in fields]
    bad = F.exists(F.array(*(F.size(forbidden_keys(c, BLIND)) for c in texts)) if texts else F.array(F.lit(0)), lambda n: n > 0)
    docs = documents(events.withColumn("bad_", bad), ["trace_id"], "event_id", [*fields, "bad_"])
    docs = docs.withColumn("document", F.to_json(F.transform("events", lambda e: e.dropFields("bad_"))))
    held = F.exists("events", lambda e: e["bad_"]) | (F.size(forbidden_keys("document", BLIND)) > 0)
    checked = docs.select("trace_id", "n_events", F.when(held, F.raise_error(F.lit("a trace holds an answer"))).otherwise(F.col("document")).alias("document"))
    checked.write.mode("errorifexists").parquet(path)


def resumable(results: DataFrame, traces: DataFrame, on: list[str]) -> DataFrame:
    """Results without a finished trace; a run with any may not be resumed."""
    return results.join(traces.select(*on).distinct(), on, "left_anti")


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Results as JSON lines, in a bounded number of folders by a hash of the question; results that are there already are an error."""
    bucketed(results, "question_id", buckets).write.mode("errorifexists").partitionBy("bucket").json(path)


# The fields of a case, in order.
CASE = ("long_id", "question", "choices", "ground_truth", "pred_answer", "explanation", "process")


def write_cases(results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One JSON line a case with the fields of ``CASE``; absent ones are null."""
    held = results.select(*(F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in CASE))
    bucketed(held, "long_id", buckets).write.mode("errorifexists").option("ignoreNullFields", False).partitionBy("bucket").json(path)


def consistent(results: DataFrame, traces: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Results whose trace says something else in one of the columns ``same``; a run with any may not be resumed."""
    other = traces.select(*on, *(F.col(c).alias(f"{c}_traced") for c in same))
    differs = F.exists(F.array(*(~F.col(c).eqNullSafe(F.col(f"{c}_traced")) for c in same)), lambda x: x)
    return results.join(other, on).where(differs)


def summary(results: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: results by ending, failures and cost."""
    counted = results.agg(F.count("*").alias("n"), F.count_if(F.col("ending") == "answered").alias("answered"), F.count_if(F.col("ending") == "abstained").alias("abstained"))
    spent = calls.agg(F.count("*").alias("calls"), F.count_if(F.coalesce(F.col("status") != 200, F.lit(True))).alias("failures"), F.sum("cost").alias("cost"))
    return counted.withColumn("one", F.lit(1)).join(spent.withColumn("one", F.lit(1)), "one").drop("one")


def new_run_id(spark: SparkSession) -> str:
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
