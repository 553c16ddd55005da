"""Exact top-k inner products by block-at-a-time pruning.

The vectors are integers; a dimension is a term and a component its weight.
Documents, sorted by key over ranges, are cut into blocks with a forward index
(their components) and, for every term, the largest and smallest weight.  A
query's bound on a block is the sum over its terms of the best that the block
holds.  Each query visits the blocks of a range by descending bound and stops as
soon as the bound is below its k-th score.

Queries are a stated set and meet the documents in chunks of bounded size, which
are sent to where the documents are; documents are not replicated.  A first wave
scores only the best block of each range for each query; the k-th best score that
it finds anywhere is where the second wave stops from its beginning, in all ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, prepare

#: Documents in a block; bytes of components of the blocks that are visited together, and of a chunk of queries.
BLOCK, GROUP_BYTES, CHUNK_BYTES = 512, 32 << 20, 16 << 20


def integer_vector(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(values, lambda x: F.floor(x * scale).cast("double")))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles."""
    size = a.shape[-1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1)
    if size < 2**53:
        return (a @ b).astype(np.int64)
    whole = lambda m: np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)
    return np.array(whole(a) @ whole(b), np.int64)


class Blocks:
    """A group of blocks of documents of one dimension, in key order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.keys, self.rows, self.vectors = keys, rows, vectors

    def cut(self, size: int = BLOCK) -> None:
        self.starts = np.arange(0, len(self.keys), size)
        self.ends = np.minimum(self.starts + size, len(self.keys))
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound on the score of each query in each block."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        size = queries.shape[1] * max(np.abs(queries).max(initial=0), 1) * max(np.abs(self.vectors).max(initial=0), 1)
        out = up @ self.high.T + down @ self.low.T
        return out if size < 2**53 else out + size * 1e-12

    def search(self, row: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float = -np.inf, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents other than ``row``, ties to the smaller key; and the blocks scored, ``most`` at most.

        ``least`` is a score that k documents are known to reach.
        """
        at, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in np.argsort(-bounds, kind="stable")[:most]:
            if bounds[b] < least or len(at) == k and bounds[b] < scores[-1]:
                break
            if len(at) == k and bounds[b] == scores[-1] and self.keys[self.starts[b]] > self.keys[at[-1]]:
                continue
            here = np.arange(self.starts[b], self.ends[b])
            new = _product(self.vectors[here], query)
            good = (self.rows[here] != row) & (new >= least)
            at, scores = np.concatenate([at, here[good]]), np.concatenate([scores, new[good]])
            if len(at) > 4 * k:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                at, scores = at[near], scores[near]
            best = np.lexsort((self.keys[at], -scores))[:k]
            at, scores, scored = at[best], scores[best], scored + 1
        return at, scores, scored


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[Blocks]:
    """The documents (key, row, dim, v) of a range as groups of one dimension and of about ``GROUP_BYTES``."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        dims = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if kept and (kept[0][2].shape[1] != dims[a] or size >= GROUP_BYTES):
                yield Blocks(*map(np.concatenate, zip(*kept)))
                kept, size = [], 0
            matrix = batch.column(3).slice(a, b - a).flatten().to_numpy().reshape(b - a, dims[a])
            kept.append((batch.column(0).slice(a, b - a).to_numpy(), batch.column(1).slice(a, b - a).to_numpy(), matrix))
            size += matrix.nbytes
    if kept:
        yield Blocks(*map(np.concatenate, zip(*kept)))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, key, score, blocks_scored, blocks): the ``k`` best documents of each query row.

    ``queries`` is a condition on the rows of ``vectors``.  A query's candidates
    are all other rows with as many components, also such as share its key.
    Vectors that are null or hold a null or non-finite component take no part, nor
    do null keys; a query without candidates has no rows.  Repeated rows count as
    often as they stand, as candidates and as queries.  ``blocks_scored`` of the
    ``blocks`` of its dimension were scored for a query by the second wave.  Scores
    are exact; one beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), integer_vector(F.col(vector), scale).alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    index = materialize(rows.repartitionByRange("dim", "key").sortWithinPartitions("dim", "key"), "vectors")
    asking = index.where("asks")
    size = asking.agg(F.sum(8 * F.col("dim"))).first()[0] or 0
    chunks = int(max(1, -(-size // CHUNK_BYTES)))
    found = None
    for chunk in range(chunks):
        held = asking.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).select("row", "key", "dim", "v").toArrow()
        asked = {d: (part["row"].to_numpy(), np.concatenate(part["v"].to_numpy()).reshape(len(part), d) if d else np.zeros((len(part), 0))) for d, part in held.to_pandas().groupby("dim")}
        best = materialize(_wave(index, spark.sparkContext.broadcast((asked, {})), k, block, 1), "first-wave")
        order = Window.partitionBy("query").orderBy(F.desc("score"))
        reached = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", "score").toArrow()
        least = dict(zip(reached["query"].to_pylist(), reached["score"].to_pylist()))
        part = _wave(index, spark.sparkContext.broadcast((asked, least)), k, block, None)
        found = part if found is None else found.unionByName(part)
    ids = index.where("asks").select(F.col("row").alias("query"), F.col("key").alias("query_id"))
    every = Window.partitionBy("query")
    top = found.withColumns({"blocks_scored": F.sum("scored").over(every), "blocks": F.sum("blocks").over(every)}).where("key is not null")
    top = top.withColumn("rank", F.row_number().over(every.orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return top.join(ids, "query").select("query_id", "rank", F.col("key").alias(key), "score", "blocks_scored", "blocks")


def _wave(index: DataFrame, held, k: int, block: int, most: int | None) -> DataFrame:
    """Rows (query, key, score, scored, blocks) of the best documents of each range for each query of a chunk; one with a null key tells of the blocks."""
    names = ["query", "key", "score", "scored", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = held.value
        for blocks in _grouped(batches):
            blocks.cut(block)
            rows, queries = asked.get(blocks.vectors.shape[1], ((), np.zeros((0, blocks.vectors.shape[1]))))
            out: list[tuple] = []
            for row, query, bounds in zip(rows, queries, blocks.bounds(queries)):
                at, scores, scored = blocks.search(row, query, bounds, k, least.get(row, -np.inf), most)
                out.append((np.full(len(at) + 1, row), np.append(blocks.keys[at], 0), np.append(scores, 0), np.append(np.zeros(len(at), np.int64), scored), np.append(np.zeros(len(at), np.int64), len(bounds)), np.append(np.zeros(len(at), bool), True)))
            if out:
                *columns, told = map(np.concatenate, zip(*out))
                arrays = [pa.array(c.astype(np.int64), mask=told if n == "key" else None) for n, c in zip(names, columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = index.select("key", "row", "dim", "v").mapInArrow(run, "query long, key long, score long, scored long, blocks long")
    return found if most is None else found.where("key is not null")
