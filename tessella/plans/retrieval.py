"""Queries on embeddings: ranking, first retrieval, replenishment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.policy import INITIAL_RATIO, REPLENISH_RATIO, retrieval_count
from tessella.functions.vectors import norm
from tessella.operators import retrieval as R
from tessella.plans.registry import query, table

_DOT = "list_dot_product(e.embedding::DOUBLE[], list_transform(q.embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))"
_SCORED = f"scored AS (SELECT e.vec_id, e.label, {_DOT} AS s FROM embeddings AS e, embeddings AS q WHERE q.vec_id = 0)"


def _scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return R.scores(e, q, "vec_id", "embedding", "q", "qv")


def _counted(e):
    return e.agg(F.count("*").alias("n")).withColumn("query_id", F.lit(0).cast("long"))


def _shown(df):
    return df.select(F.col("id").alias("vec_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SCORED} SELECT vec_id, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM scored)
    WHERE rank <= (SELECT greatest(1, trunc(count(*) * {INITIAL_RATIO}::DOUBLE)) FROM embeddings)""")
def vector_topk(spark, sf_dir):
    """The first retrieval for the query vector of vec_id 0."""
    e = table(spark, sf_dir, "embeddings")
    return _shown(R.initial(_scored(spark, sf_dir), _counted(e), ["query_id"]))


@query(f"""WITH {_SCORED} SELECT label, vec_id, round(s, 4) AS score, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM scored) WHERE rank <= 2""")
def vector_topk_per_slide(spark, sf_dir):
    """The two best tiles of each slide."""
    slides = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    best = R.top_k(_scored(spark, sf_dir).join(slides, "id"), ["label"], 2)
    return best.select("label", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SCORED}, n AS (SELECT count(*) AS n FROM embeddings), ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM scored)
    SELECT vec_id, round(s, 4) AS score, (r - greatest(1, trunc(n * {INITIAL_RATIO}::DOUBLE)))::BIGINT AS rank FROM ranked, n
    WHERE r > greatest(1, trunc(n * {INITIAL_RATIO}::DOUBLE)) AND r <= greatest(1, trunc(n * {INITIAL_RATIO}::DOUBLE)) + greatest(1, trunc(n * {REPLENISH_RATIO}::DOUBLE))""")
def vector_replenish(spark, sf_dir):
    """The next retrieval after the first."""
    e = table(spark, sf_dir, "embeddings")
    scored, n = _scored(spark, sf_dir), _counted(e)
    return _shown(R.replenish(scored, n, R.initial(scored, n, ["query_id"]).select("query_id", "id"), ["query_id"]))


@query(f"""SELECT label, count(*) AS n, greatest(1, trunc(count(*) * {INITIAL_RATIO}::DOUBLE))::BIGINT AS initial_k,
    greatest(1, trunc(count(*) * {REPLENISH_RATIO}::DOUBLE))::BIGINT AS replenish_k, least(count(*), 10)::BIGINT AS fixed_k FROM embeddings GROUP BY label""")
def retrieval_k_policy(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    k = lambda *a: retrieval_count(F.col("n"), *a)
    return n.select("label", "n", k(INITIAL_RATIO).alias("initial_k"), k(REPLENISH_RATIO).alias("replenish_k"), k(1.0, 10).alias("fixed_k"))


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity,
    round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS length FROM embeddings AS e, embeddings AS q WHERE q.vec_id = 0""")
def normalized_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    pairs = e.join(q, F.size("embedding") == F.size("q"))
    return pairs.select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 4).alias("similarity"), F.round(norm(F.col("embedding")), 4).alias("length"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS s FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def multi_query_topk(spark, sf_dir):
    """Five tiles for each query; queries are the rows whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    best = R.best(e, q, "vec_id", "embedding", "q", "qv", 5)
    return best.select("query_id", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SCORED} SELECT label, vec_id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM scored) WHERE r = 1""")
def nearest_child(spark, sf_dir):
    slides = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    best = R.nearest_child(_scored(spark, sf_dir).join(slides, "id"), ["label"])
    return best.select("label", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"))
