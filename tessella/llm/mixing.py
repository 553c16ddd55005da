"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only.  Every document gets the exponential key
``-ln(u) / weight``, where ``u`` in (0, 1) is a hash of its key and the weight
comes from its quality; within a source, documents are taken by ascending key.
A source's target is met by complete epochs over all its documents and then by
the documents whose prefix sums of sizes fit in what is left.

Prefix sums are made in two levels: a source of n documents has about sqrt(n)
ranges of keys, the ranges' sums are accumulated within the source, and the
documents' within their range, so no task holds more than about sqrt(n) rows of
a source at once, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, broadcast_if_few, free_name, materialize

#: Weights of the sources in code-point order, repeating; and how many times its size a source may give.
WEIGHTS, MOST = (5, 2, 1), 3
#: Sampling weights of documents of good, unknown and bad quality.
GOOD, UNKNOWN, BAD = 2.0, 1.5, 1.0


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def exponential_key(key: Column, weight: Column) -> Column:
    """The Efraimidis-Spirakis key of a document; equal document keys give equal results in every run."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 0.5) / float(16**13)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, size, docs) with ``weight`` and ``target``: one row for each source, null the last.

    All sizes are shared by weight.  A source whose share is above ``most`` times
    its size gets just that, and the excess goes to the others by weight.  In the
    order of ``most * size / weight`` the sources that are stopped come first, so
    the level of the others is the largest of the levels at which a source would
    not be stopped.  The windows run over sources, not over documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.col("size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = ranked.withColumn("level", (F.sum("size").over(everything) - before) / after)
    own = own.withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return own.withColumn("target", target).select("source", "size", "docs", "weight", "target")


def quality_weight(quality: Column) -> Column:
    return F.when(quality == 1, GOOD).when(quality == 0, BAD).otherwise(UNKNOWN)


def mix_plan(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, size, source_size, target, taken, source, copies, text_hash), one per row of ``documents``.

    ``size`` counts words; ``copies`` says how often the mix takes the document
    and ``taken`` is ``copies * size``.  ``labels`` (the key and ``quality`` 1 or
    0; the larger where a key repeats) weigh the sampling.  A null source is a
    source of its own, last in order; null and empty texts have size 0; a source
    without words has target 0.  A document is taken in part of an epoch if the
    middle of its words is within the rest of the target.  Equal keys share a
    place in the order and are taken one after another.  Extra columns are
    ignored.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(text)).alias("text_hash"))
    if labels is None:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    else:
        known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("labelled")).agg(F.max("quality").alias("quality"))
        rows = rows.join(known, F.col("key") == F.col("labelled"), "left").drop("labelled")
    rows = rows.withColumn("draw", exponential_key(F.col("key"), quality_weight(F.col("quality")))).drop("quality")
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    aims = targets(sizes).select(F.col("source").alias("of"), F.col("size").alias("source_size"), "docs", "target")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = materialize(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    same = (F.coalesce("source", F.lit("")) == F.coalesce("of", F.lit(""))) & (F.col("source").isNull() == F.col("of").isNull())
    ranges = F.ceil(F.sqrt("docs"))
    placed = rows.join(aims, same).drop("of").withColumn("range", F.least(F.floor((1 - F.exp(-F.col("draw"))) * ranges), ranges - 1))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    below = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("sum").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("draw", "key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ordered = ordered.join(sums, same & (F.col("range") == F.col("at"))).drop("of", "at")
    fits = (F.col("rest") > 0) & (F.col("base") + F.col("before") + F.col("size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + fits.cast("long")
    out = ordered.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", F.col("source").alias(source), "copies", "text_hash")


def mixed_documents(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it.

    Rows that share a key (or have none) are told apart by source and text; those
    that share these as well are taken equally often, as often as the most taken one.
    """
    names = {x: free_name(documents, x) for x in ("of_key", "of_source", "of_text", "copies", "copy")}
    plan = mix_plan(documents, labels, key, text, source)
    plan = plan.groupBy(F.col(key).alias(names["of_key"]), F.col(source).alias(names["of_source"]), F.col("text_hash").alias(names["of_text"])).agg(F.max("copies").alias(names["copies"]))
    plan = broadcast_if_few(materialize(plan.where(F.col(names["copies"]) > 0), "copies"))
    same = documents[key].eqNullSafe(plan[names["of_key"]]) & documents[source].eqNullSafe(plan[names["of_source"]]) & (F.xxhash64(documents[text]) == plan[names["of_text"]])
    taken = documents.join(plan, same).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))))
    return taken.drop(*names.values())
