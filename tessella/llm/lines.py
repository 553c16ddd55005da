"""Dropping lines that many documents share.

Distinct line keys are counted once over the corpus by their 128-bit hashes.
The keys that are too common go into shards of a minimal perfect hash; beside
each slot stand a 64-bit fingerprint (so that a foreign line passes with
probability 2**-64 beyond the hash itself), the number of documents and the
largest document key.  Documents probe these arrays; lines are not joined.

The arrays of all common keys are broadcast while they are few (``max_broadcast``
keys at 24 bytes).  Beyond that only the keys with the most documents are
broadcast, whose number the counts bound, and only lines that these do not decide
on are sent to the shard of their hash, so no shard is hot; their verdicts come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary_views, materialize, prepare, utf8
from tessella.llm.mphf import MinimalPerfectHash

#: Keys of a broadcast index (24 bytes each) and of a shard.
MAX_BROADCAST, SHARD_KEYS = 1_000_000, 500_000
#: Text whose lines probe one shard, where lines are sent to shards.
SHARD_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def hash_key(key: bytes) -> int:
    return xxhash.xxh3_128_intdigest(key)


def hashes_of(text: bytes, min_chars: int) -> list[int | None]:
    """The hash of each line's key; None where the key is short."""
    out: list[int | None] = []
    for line in text.split(b"\n"):
        key = line_key(line)
        out.append(hash_key(key) if len(key) >= min_chars and code_points(key) >= min_chars else None)
    return out


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), "<u8").reshape(-1, 2)
    return raw[:, 1], raw[:, 0]


class LineIndex:
    """The arrays of one shard."""

    def __init__(self, high: np.ndarray, low: np.ndarray, docs: np.ndarray, last: np.ndarray):
        high, low = high.view(np.uint64), low.view(np.uint64)
        self.hash = MinimalPerfectHash.build(high, low)
        order = np.argsort(self.hash.slots(high, low))
        self.prints, self.docs, self.last = low[order], docs[order], last[order]

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not in the index."""
        high, low = high.view(np.uint64), low.view(np.uint64)
        slot = self.hash.slots(high, low)
        there = slot >= 0
        slot[there] = np.where(self.prints[slot[there]] == low[there], slot[there], -1)
        return slot


def common_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (high, low, docs, last): hashes of line keys in at least ``min_docs`` rows, their number and the largest document key."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({h for h in hashes_of(t, min_chars) if h is not None}) for t in binary_views(batch.column(1))]
            high, low = _halves([h for hs in found for h in hs])
            docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), docs], names=["high", "low", "key"])

    lines = df.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text")).mapInArrow(run, "high long, low long, key long")
    counts = lines.groupBy("high", "low").agg(F.count("*").alias("docs"), F.max("key").alias("last"))
    return counts.where(F.col("docs") >= min_docs)


def _columns(rows: DataFrame) -> tuple[np.ndarray, ...]:
    got = rows.select("high", "low", "docs", "last").toArrow()
    high, low, docs, last = (got[c].to_numpy() for c in ("high", "low", "docs", "last"))
    return high.view(np.uint64), low.view(np.uint64), docs, last


def _routed(rows: DataFrame, keys: DataFrame, hot: Broadcast, shards: int, min_chars: int) -> DataFrame:
    """Rows (row_id, gone): the line numbers that the shards of ``keys`` drop from each of ``rows`` (key, text, row_id).

    Lines whose keys are in the index ``hot`` are not sent: it decides on them where they are.
    """
    shard = F.pmod(F.col("high"), F.lit(shards)).cast("int")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(*hot.value)
        for batch in batches:
            found = [[(i, h) for i, h in enumerate(hashes_of(t, min_chars)) if h is not None] for t in binary_views(batch.column(1))]
            high, low = _halves([h for hs in found for _, h in hs])
            sent = index.slots(high, low) < 0
            high, low = high[sent], low[sent]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])[sent])
            number = pa.array(np.array([i for hs in found for i, _ in hs], np.int32)[sent])
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column(0).take(at), batch.column(2).take(at), number], names=["high", "low", "key", "row_id", "line"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(len(left), bool)
        if len(left) and len(right):
            index = LineIndex(*(right[c].to_numpy() for c in ("high", "low", "docs", "last")))
            slot = index.slots(left["high"].to_numpy(), left["low"].to_numpy())
            key = left["key"].combine_chunks()
            other = key.is_null().to_numpy(zero_copy_only=False) | (key.fill_null(0).to_numpy(zero_copy_only=False) != index.last[slot])
            hit = (slot >= 0) & other
        return left.select(["row_id", "line"]).filter(pa.array(hit))

    probes = rows.mapInArrow(lines, "high long, low long, key long, row_id long, line int")
    sides = probes.withColumn("shard", shard).groupBy("shard").cogroup(keys.withColumn("shard", shard).groupBy("shard"))
    hits = sides.applyInArrow(probe, "row_id long, line int")
    return hits.groupBy("row_id").agg(F.collect_list("line").alias("gone"))


def drop_common_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows (key, n_lines, n_dropped, kept_text), one per row of ``df``.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` rows stays only in the rows with the largest document key
    that holds it.  A null or empty text is one empty line.  Rows count as
    documents, also with equal keys; a null key is smaller than all others, and
    a line that only such rows hold stays in them.  A document that loses all
    its lines keeps an empty text.  Extra columns are ignored.
    """
    spark = df.sparkSession
    found = materialize(common_lines(df, key, text, min_chars, min_docs).where("last is not null"), "lines")
    total, most = found.agg(F.count("*"), F.sum("docs")).first()
    floor = 0 if total <= max_broadcast else -(-most // max_broadcast)
    index = spark.sparkContext.broadcast(_columns(found.where(F.col("docs") >= floor)))
    rows = df.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"))
    nothing = F.array().cast("array<int>")
    if floor:
        rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "texts")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
        back = _routed(rows, found.where(F.col("docs") < floor), index, max(-(-total // SHARD_KEYS), -(-size // SHARD_BYTES)), min_chars)
        rows = rows.join(back, "row_id", "left").select("key", "text", F.coalesce("gone", nothing).alias("gone"))
    else:
        rows = rows.withColumn("gone", nothing)
    built: dict[int, LineIndex] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in built:
            built[0] = LineIndex(*index.value)
        arrays = built[0]
        for batch in batches:
            texts, keys = list(binary_views(batch.column(1))), batch.column(0).to_pylist()
            found = [hashes_of(t, min_chars) for t in texts]
            flat = [h for hs in found for h in hs if h is not None]
            slots = iter(arrays.slots(*_halves(flat)).tolist())
            n_lines, n_dropped, kept = [], [], []
            for t, k, hs, gone in zip(texts, keys, found, batch.column(2).to_pylist()):
                out = set(gone)
                for i, h in enumerate(hs):
                    if h is not None and (s := next(slots)) >= 0 and (k is None or arrays.last[s] != k):
                        out.add(i)
                n_lines.append(len(hs))
                n_dropped.append(len(out))
                kept.append(b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in out) if out else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_lines", "n_dropped", "kept_text"])

    return rows.mapInArrow(run, "key long, n_lines long, n_dropped long, kept_text string").withColumnRenamed("key", key)


def line_report(df: DataFrame, **options) -> DataFrame:
    """``drop_common_lines`` with the SHA-256 of the kept text in its place."""
    out = drop_common_lines(df, **options)
    return out.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")
