"""Ranking tiles by their embeddings, first retrieval and replenishment."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.checkpoints import kept
from tessella.functions.policy import INITIAL_RATIO, REPLENISH_RATIO, retrieval_count
from tessella.functions.vectors import dot, unit
from tessella.shipping import ship

#: Queries that are broadcast to the features; more go in blocks of their own.
MAX_BROADCAST_QUERIES = 10_000
#: Rows of keys and numbers that are broadcast.
MAX_BROADCAST_KEYS = 200_000
#: Rows of a block of features and of a block of queries, and queries that are scored at once.
FEATURE_BLOCK, QUERY_BLOCK, AT_ONCE = 4096, 2048, 256
#: Scores of a block that tell how the others lie, and scores that are summed at once.
MARKS, SUMMED_AT_ONCE = 64, 32_768


def scores(features: DataFrame, queries: DataFrame, id: str, vector: str, query_id: str, query: str) -> DataFrame:
    """Rows (query_id, id, score): every query (scaled to length 1) against every feature.

    The queries are a stated set; they are counted, and only a set of at most
    ``MAX_BROADCAST_QUERIES`` is sent to the features whole.  Larger sets are
    met block by block.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), unit(F.col(query)).alias("__q"))
    n = asked.count()
    blocks = max(1, -(-n // MAX_BROADCAST_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    out = None
    for i in range(blocks):
        some = asked.where(block == i) if blocks > 1 else asked
        pairs = features.join(F.broadcast(some), F.size(vector) == F.size("__q"))
        part = pairs.select("query_id", F.col(id).alias("id"), dot(F.col(vector), F.col("__q")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def ranked(scored: DataFrame, by: list[str], id: str = "id", score: str = "score") -> DataFrame:
    """With ``rank`` from 1 in each group, by descending score and then the id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id)))


def top_k(scored: DataFrame, by: list[str], k: int, id: str = "id") -> DataFrame:
    """The first ``k`` of each group; with a literal ``k`` every task keeps only so many before the shuffle."""
    return ranked(scored, by, id).where(F.col("rank") <= k)


def ranked_to(scored: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """``scored`` (group, id, score) with rank, down to the ``k`` (at least 0) that ``limits`` (group, n, k) gives each group of ``n`` rows.

    Scores are dealt to about sqrt(n) ranges between the group's least and best.
    The ranges are counted; only the rows of those that begin above the ``k``-th
    place are ranked, each within its range, and the rows before a range are added.
    So no task holds a group, however large ``k`` is.  Scores are written once.
    """
    scored = kept(scored)
    ends = scored.groupBy(*by).agg(F.min("score").alias("low"), F.max("score").alias("high")).join(limits, by)
    ranges = F.ceil(F.sqrt("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("high") - F.col("score")) / (F.col("high") - F.col("low")) * ranges), ranges - 1)).otherwise(F.lit(0))
    dealt = scored.join(ends, by).withColumn("range_", place.cast("long"))
    counts = dealt.groupBy(*by, "range_").agg(F.count("*").alias("in_range"), F.first("k").alias("k"))
    above = F.coalesce(F.sum("in_range").over(Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = counts.withColumn("above", above).where(F.col("above") < F.col("k")).select(*by, "range_", "above")
    within = F.row_number().over(Window.partitionBy(*by, "range_").orderBy(F.desc("score"), "id"))
    out = dealt.join(needed, [*by, "range_"]).withColumn("rank", F.col("above") + within)
    return out.where(F.col("rank") <= F.col("k")).select(*scored.columns, "rank")


def initial(scored: DataFrame, available: DataFrame, by: list[str], ratio: float = INITIAL_RATIO, top_k: int | None = None) -> DataFrame:
    """The first retrieval of each group: ``available`` has the group's columns and ``n``, its number of tiles."""
    return ranked_to(scored, available.select(*by, "n", retrieval_count(F.col("n"), ratio, top_k).alias("k")), by)


def replenish(scored: DataFrame, available: DataFrame, seen: DataFrame, by: list[str], ratio: float = REPLENISH_RATIO, top_k: int | None = None) -> DataFrame:
    """The next tiles of each group that are not in ``seen``; how many follows all tiles, not those that remain."""
    return initial(scored.join(seen, [*by, "id"], "left_anti"), available, by, ratio, top_k)


def few(rows: DataFrame, most: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``rows`` (kept; they are counted) to be broadcast, unless they are more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _finite(vector: Column) -> Column:
    """Whether a vector is there and has no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (id, vector) as rows (size, ids, vectors): up to ``size`` vectors of one length, in double precision one after another."""
    kind = dict(rows.dtypes)["id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(n: int, some: pa.Table) -> pa.RecordBatch:
            ids, flat = some["id"].combine_chunks(), pc.list_flatten(some["vector"]).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([flat.tobytes()])], names=["size", "ids", "vectors"])

        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = pc.list_value_length(table["vector"])
            for n in pc.unique(sizes).to_pylist():
                held.setdefault(n, []).append(table.filter(pc.equal(sizes, n)))
                if sum(map(len, held[n])) >= size:
                    whole = pa.concat_tables(held.pop(n))
                    full = len(whole) // size * size
                    yield from (block(n, whole.slice(k, size)) for k in range(0, full, size))
                    if full < len(whole):
                        held[n] = [whole.slice(full)]
        yield from (block(n, pa.concat_tables(some)) for n, some in held.items())

    return rows.mapInArrow(pack, f"size int, ids array<{kind}>, vectors binary")


def best(features: DataFrame, queries: DataFrame, id: str, vector: str, query_id: str, query: str, k: int) -> DataFrame:
    """Rows (query_id, id, score, rank): the ``k`` best features of every query, as ``top_k`` of ``scores`` gives them.

    Every query meets every feature, in blocks.  A matrix product tells, up to
    rounding, what reaches the ``k``-th place that a query has had in this task so
    far; only that is scored exactly, and of a block at most ``k`` a query go on.
    Vectors with null or non-finite components, which have no such bound, are
    scored by ``scores``.  A task holds one block of each side.
    """
    ship(features.sparkSession)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("query"), _finite(unit(F.col(query))).alias("plain"))
    rows = features.select(F.col(id).alias("id"), F.col(vector).alias("vector"), _finite(F.col(vector)).alias("plain"))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    n = asked.count()
    parts = 3 * features.sparkSession.sparkContext.defaultParallelism
    of = _blocks(asked.where("plain").select(F.col("query_id").alias("id"), unit(F.col("query")).alias("vector")).coalesce(max(1, -(-n // QUERY_BLOCK))), QUERY_BLOCK).withColumnsRenamed({"ids": "query_ids", "vectors": "queries", "size": "query_size"})
    to = _blocks(rows.where("plain").select("id", double(F.col("vector")).alias("vector")), FEATURE_BLOCK).repartition(parts)
    to = to.join(F.broadcast(of), F.col("size") == F.col("query_size")) if n <= MAX_BROADCAST_QUERIES else to.join(of.hint("shuffle_replicate_nl"), F.col("size") == F.col("query_size"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, np.ndarray] = {}  # the k-th score so far of each query, by the block of queries
        for batch in batches:
            for i in range(len(batch)):
                size, ids, asks = batch["size"][i].as_py(), batch["ids"][i].values, batch["query_ids"][i].values
                f, q = (np.frombuffer(batch[c][i].as_buffer(), float).reshape(len(x), size) for c, x in (("vectors", ids), ("queries", asks)))
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                slack = 4e-16 * (size + 2) * max(1.0, float(np.sqrt((f * f).sum(axis=1)).max()))
                before = place.setdefault(hashlib.md5(batch["queries"][i].as_buffer()).digest(), np.full(len(asks), -np.inf))
                for a in range(0, len(asks), AT_ONCE):
                    some = q[a : a + AT_ONCE]
                    near = some @ f.T
                    least = before[a : a + AT_ONCE]
                    if len(ids) >= k and (least == -np.inf).any():
                        least = np.maximum(least, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
                    x, y = np.nonzero(~(near < (least - 2 * slack)[:, None]))
                    exact = np.zeros(len(x))
                    for c in range(size):
                        exact += f[y, c] * some[x, c]
                    by = np.lexsort((order[y], -exact, x))
                    x, y, exact = x[by], y[by], exact[by]
                    start = np.searchsorted(x, np.arange(len(some)))
                    on = np.arange(len(x)) - start[x] < k
                    last = start + k - 1
                    full = last < np.append(start[1:], len(x))
                    before[a : a + AT_ONCE][full] = np.maximum(before[a : a + AT_ONCE][full], exact[last[full]])
                    yield pa.RecordBatch.from_arrays([asks.take(pa.array(x[on] + a)), ids.take(pa.array(y[on])), pa.array(exact[on])], names=["query_id", "id", "score"])

    given = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]
    met = to.select("size", "ids", "vectors", "query_ids", "queries").mapInArrow(meet, f"query_id {given[0]}, id {given[1]}, score double")
    odd = scores(rows.where("not plain"), asked, "id", "vector", "query_id", "query").unionByName(scores(rows.where("plain"), asked.where("not plain"), "id", "vector", "query_id", "query"))
    return top_k(met.unionByName(odd), ["query_id"], k)


@dataclass(frozen=True)
class Grouped:
    """Vectors of groups, held for ``nearest``.

    ``vectors`` has ``by``, id and vector; ``blocks`` (``by``, size, ids, vectors)
    those with finite components alone; ``odd`` (as ``vectors``) the others, if there are any.
    """

    by: str
    vectors: DataFrame
    blocks: DataFrame
    odd: DataFrame | None


def _packed(rows: DataFrame, by: str, blocks: Column) -> DataFrame:
    """``rows`` (``by``, id, vector) as rows (``by``, size, ids, vectors): those of a group dealt to as many as ``blocks`` says, vectors of one length, in double precision one after another."""
    kinds = dict(rows.dtypes)

    def pack(some: pa.Table) -> pa.Table:
        ids, flat = some["id"].combine_chunks(), pc.list_flatten(some["vector"]).to_numpy()
        if pa.types.is_struct(ids.type):
            ids = ids.cast(pa.struct([f.with_nullable(True) for f in ids.type]))
        return pa.table([some[by].slice(0, 1), some["size"].slice(0, 1), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([flat.tobytes()])], names=[by, "size", "ids", "vectors"])

    double = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    dealt = rows.select(by, "id", double, F.size("vector").alias("size"), F.pmod(F.xxhash64("id"), blocks).alias("block"))
    return dealt.groupBy(by, "size", "block").applyInArrow(pack, f"{by} {kinds[by]}, size int, ids array<{kinds['id']}>, vectors binary")


def grouped(features: DataFrame, by: str) -> Grouped:
    """``features`` (``by``, id, vector) packed in blocks by their groups, however large one is."""
    ship(features.sparkSession)
    vectors = features.select(by, "id", "vector").where(F.col(by).isNotNull())
    blocks = vectors.groupBy(by).agg(F.ceil(F.count("*") / FEATURE_BLOCK).alias("in_group"))
    plain = vectors.where(_finite(F.col("vector"))).join(blocks, by)
    odd = kept(vectors.where(~_finite(F.col("vector"))))
    return Grouped(by, vectors, kept(_packed(plain, by, F.col("in_group"))), None if odd.isEmpty() else odd)


def nearest(held: Grouped, queries: DataFrame) -> DataFrame:
    """Rows (query_id, id, score): of each of ``queries`` (the group, query_id, query at length 1, need) at least the ``need`` best vectors of its group, with ties.

    A query meets all blocks of its group twice.  First every block tells the score
    of each 64th part of its vectors, in order; where the parts that reach a score
    come to ``need``, nothing below it is among the best.  Then what reaches that
    score leaves the blocks, which is ``need`` rows a query and a 64th of the group
    at most, but for ties.  A task holds one block of each side.  Products are
    summed in order, as ``dot`` does, so equal vectors score alike wherever they
    are.  Vectors and queries without such an order are scored by ``dot``, and all given.
    """
    by = held.by
    asked = kept(queries.select(by, "query_id", "query", "need", _finite(F.col("query")).alias("plain")))
    n = asked.count()
    kinds = dict(asked.dtypes)["query_id"], dict(held.vectors.dtypes)["id"]

    def met(least: DataFrame, give: Callable[[pa.Array, pa.Array, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        rows = least.where("plain").select(by, F.struct("query_id", "least").alias("id"), F.col("query").alias("vector"))
        of = _packed(rows, by, F.lit(max(1, -(-n // QUERY_BLOCK)))).withColumnsRenamed({"ids": "query_ids", "vectors": "queries"})
        of = F.broadcast(of) if n <= MAX_BROADCAST_QUERIES else of.hint("shuffle_replicate_nl")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    size, ids, asks = batch["size"][i].as_py(), batch["ids"][i].values, batch["query_ids"][i].values
                    f, q = (np.frombuffer(batch[c][i].as_buffer(), float).reshape(len(x), size) for c, x in (("vectors", ids), ("queries", asks)))
                    f, at_once = np.ascontiguousarray(f.T), max(1, SUMMED_AT_ONCE // len(ids))
                    for a in range(0, len(asks), at_once):
                        some = q[a : a + at_once]
                        total, product = np.zeros((len(some), len(ids))), np.empty((len(some), len(ids)))
                        for c in range(size):
                            np.multiply(some[:, c, None], f[c], out=product)
                            total += product
                        yield give(ids, asks.slice(a, len(some)), total)

        return held.blocks.join(of, [by, "size"]).select("size", "ids", "vectors", "query_ids", "queries").mapInArrow(meet, schema)

    def mark(ids: pa.Array, asks: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        part = max(1, len(ids) // MARKS)
        marks = -np.sort(-np.where(np.isnan(total), np.inf, total), axis=1)[:, part - 1 :: part]  # Spark puts NaN first, too
        of = np.repeat(np.arange(len(asks)), marks.shape[1])
        return pa.RecordBatch.from_arrays([pc.struct_field(asks, "query_id").take(pa.array(of)), pa.array(marks.ravel()), pa.array(np.full(marks.size, part, np.int64))], names=["query_id", "score", "part"])

    def reach(ids: pa.Array, asks: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        least = pc.fill_null(pc.struct_field(asks, "least"), -np.inf).to_numpy(zero_copy_only=False)
        x, y = np.nonzero(~(total < least[:, None]))
        return pa.RecordBatch.from_arrays([pc.struct_field(asks, "query_id").take(pa.array(x)), ids.take(pa.array(y)), pa.array(total[x, y])], names=["query_id", "id", "score"])

    marks = met(asked.withColumn("least", F.lit(None).cast("double")), mark, f"query_id {kinds[0]}, score double, part long")
    so_far = F.sum("part").over(Window.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    needs = asked.select("query_id", "need")
    least = marks.withColumn("so_far", so_far).join(F.broadcast(needs) if n <= MAX_BROADCAST_KEYS else needs, "query_id").where(F.col("so_far") >= F.col("need")).groupBy("query_id").agg(F.max("score").alias("least"))
    out = met(asked.join(least, "query_id", "left"), reach, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    score = dot(F.col("vector"), F.col("query")).alias("score")
    if held.odd is not None:
        out = out.unionByName(held.odd.join(asked, by).select("query_id", "id", score))
    if not (odd := asked.where("not plain")).isEmpty():
        out = out.unionByName(held.vectors.where(_finite(F.col("vector"))).join(odd, by).select("query_id", "id", score))
    return out


def nearest_child(scored: DataFrame, by: list[str]) -> DataFrame:
    """The best tile of each group, ties to the smaller id."""
    best = F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))
    return scored.groupBy(*by).agg(best.alias("best")).select(*by, "best.id", "best.score")


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))
