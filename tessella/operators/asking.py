"""Asking a model for many rollouts at once: what is known is not asked, and what does not parse is asked again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.checkpoints import cut
from tessella.operators.calls import Meter, cache_key, call_in_waves
from tessella.operators.decisions import kind, parsed

CACHE = "cache_key string, reply string"


@dataclass
class Asking:
    """Who is asked, and within what.

    ``send`` takes a request's text and returns status, reply and token counts;
    ``cache`` is a folder that holds every reply that was given, which runs may
    share; ``meter`` has the budget and the failures so far; ``options`` are those
    of ``calls.call``.
    """

    send: Callable[[str], dict]
    cache: str
    meter: Meter = field(default_factory=Meter)
    options: dict = field(default_factory=dict)


def known(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cache_key, reply) of a cache; none if there is no such folder yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("cache_key").agg(F.min("reply").alias("reply"))


def is_object(reply: Column) -> Column:
    """Whether a reply is, or holds, a JSON object."""
    return F.coalesce(kind(parsed(reply)) == "OBJECT", F.lit(False))


def ask(requests: DataFrame, key: list[str], asking: Asking, operation: str, parses: bool) -> DataFrame:
    """Rows (key, reply, status) for ``requests`` (key, request).

    Equal requests are one.  A reply in the cache is taken from there; the others
    are sent in waves, in the order of their hashes.  With ``parses``, a reply
    without a JSON object is asked for once more, and the second one is taken as
    it is.  Every reply goes to the cache, so none is paid for twice, in this run
    or in one that goes on with it.  ``status`` is 200 where there is a reply, and
    tells otherwise why there is none.
    """
    spark = requests.sparkSession
    keyed = cut(requests.withColumn("cache_key", cache_key({"operation": F.lit(operation), "request": F.col("request")})))
    unknown = cut(keyed.select("cache_key", "request").dropDuplicates(["cache_key"]).join(known(spark, asking.cache), "cache_key", "left_anti"))

    def sent(some: DataFrame) -> DataFrame:
        return call_in_waves(some, asking.send, "cache_key", "request", asking.meter, **asking.options).select("cache_key", "reply", "status")

    def replied(rows: DataFrame) -> DataFrame:
        return rows.where((F.col("status") == 200) & (F.coalesce("reply", F.lit("")) != "")).select("cache_key", "reply")

    first = sent(unknown)
    given = replied(first)
    if parses:
        broken = cut(given.where(~is_object(F.col("reply"))))
        if broken.head(1):
            second = replied(sent(unknown.join(broken.select("cache_key"), "cache_key", "left_semi")))
            given = given.join(broken.select("cache_key"), "cache_key", "left_anti").unionByName(second).unionByName(broken.join(second.select("cache_key"), "cache_key", "left_anti"))
    given.write.mode("append").parquet(asking.cache)
    out = keyed.join(known(spark, asking.cache), "cache_key", "left").join(first.select("cache_key", "status"), "cache_key", "left")
    return cut(out.select(*key, "reply", F.when(F.col("reply").isNotNull(), 200).otherwise(F.col("status")).alias("status")))
