"""SimHash near-duplicates through an embedding of segment bit counts.

A 64-bit fingerprint is cut into 32 segments of 2 bits and mapped to the vector
of their bit counts.  The Manhattan distance of two such vectors is never above
the Hamming distance of the fingerprints.  The grid range-join puts every
fingerprint into the cells within distance 1 of its own vector: two vectors at
distance 2 or less share a cell.  Fingerprints that share no cell with another
one are done.  The others are verified exactly, and again without pairs: two
fingerprints differ in at most 2 bits just if some 64-bit word differs from each
of them in at most 1 bit, so all fingerprints around such a word are linked to
the smallest of them.  Both steps emit a fixed number of rows per distinct
fingerprint, however many copies or neighbours it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import similar
from tessella.llm.common import binary_views, broadcast_if_few, forget, free_name, materialize, own_columns, prepare, row_hash, utf8
from tessella.llm.components import components
from tessella.llm.similar import Words, alike, candidates, packed_set, slices, spread

SEED = 42
SEGMENTS, WIDTH = 32, 2
#: Text bytes whose shingles are made at once.
SLICE_BYTES = 1 << 20
#: For each byte value, which of its 8 bits are set.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The fingerprint of a text given in UTF-8, as an unsigned number; 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(columns[:, i], minlength=256) for i in range(8)]) @ _BITS
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8).ravel(), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Rows (key, text_hash, fp), fp as a signed 64-bit number with the bits of the fingerprint."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_per_shingle) for t in binary_views(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["key", "text_hash", "fp"])

    return _rows(df, key, text).mapInArrow(run, "key long, text_hash long, fp long")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), utf8(text).alias("text"))


def _counts(fp: Column) -> Column:
    """The bit counts of the segments, 2 bits to a count."""
    counts = (F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit(3).cast("long"))) for i in range(SEGMENTS))
    return reduce(Column.bitwiseOR, (F.shiftleft(c.cast("long"), WIDTH * i) for i, c in enumerate(counts)))


def _cells(own: Column) -> Column:
    """The grid cells within Manhattan distance 1 of the counts ``own``.

    A step between the counts 0 and 1 turns the lower of the two bits, one between 1 and 2 both.
    """
    mask = lambda bits, i: F.shiftleft(F.lit(bits).cast("long"), WIDTH * i)
    low = [F.when(own.bitwiseAND(mask(2, i)) == 0, own.bitwiseXOR(mask(1, i))) for i in range(SEGMENTS)]
    high = [F.when(own.bitwiseAND(mask(3, i)) != 0, own.bitwiseXOR(mask(3, i))) for i in range(SEGMENTS)]
    return F.filter(F.array(own, *low, *high), lambda x: x.isNotNull())


def _ball(fp: Column) -> Column:
    """A fingerprint and the 64 words that differ from it in one bit."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints ``fp`` of ``nodes`` (distinct) at 2 or fewer differing bits."""

    def shared(rows: DataFrame) -> DataFrame:
        return rows.groupBy("at").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("at", "low")

    cells = nodes.withColumn("own", _counts(F.col("fp"))).select("fp", F.explode(_cells(F.col("own"))).alias("at"))
    crowded = materialize(shared(cells).select("at"), "cells")
    near = materialize(cells.join(crowded, "at", "left_semi").select("fp").distinct(), "near")
    balls = near.select("fp", F.explode(_ball(F.col("fp"))).alias("at"))
    centres = materialize(shared(balls), "centres")
    return balls.join(centres, "at").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def _signatures(df: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """Rows (key, text_hash, fp, words, bands): besides the fingerprint a hash of all words, and MinHash bands of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                fps = [fingerprint(t, words_per_shingle) for t in binary_views(texts)]
                same, _, shingles, count = shingle_sets(texts, words_per_shingle)
                bands = np.zeros((len(texts), similar.BANDS), np.uint64)
                bands[count > 0] = similar.minhash_bands(shingles, count[count > 0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, similar.BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                columns = [*(c.slice(at, len(texts)) for c in batch.columns[:2]), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(same), lists, pa.array(count > 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "fp", "words", "bands", "some"])

    found = _rows(df, key, text).mapInArrow(run, "key long, text_hash long, fp long, words long, bands array<long>, some boolean")
    return found.withColumn("bands", F.when(F.col("some"), F.col("bands")).otherwise(F.array().cast("array<long>"))).drop("some")


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    """A hash of all words of each text (as signed numbers), its words, and its shingles of ``n`` words (all words, if fewer) and their number."""
    words = Words(texts)
    first, size = words.texts[:-1], np.diff(words.texts)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    shingles = words.shingles(n)[spread(first, count)]
    short = np.flatnonzero((size > 0) & (size < n))
    starts = np.cumsum(count) - count
    same = np.array([xxhash.xxh3_64_intdigest(words.hashes[a : a + k].tobytes()) for a, k in zip(first.tolist(), size.tolist())], np.uint64)
    shingles[starts[short]] = same[short]
    return same.view(np.int64), words, shingles, count


def _distinct(signatures: DataFrame) -> DataFrame:
    """Distinct texts (item, key, node, bands); texts with equal words stand for each other."""
    one = signatures.groupBy(F.col("words").alias("item")).agg(F.min("key").alias("key"), F.any_value("fp").alias("node"), F.any_value("bands").alias("bands"))
    return materialize(one.where("key is not null"), "distinct-texts")


def _shingles(df: DataFrame, one: DataFrame, buckets: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """Rows (item, shingles) of the texts in ``buckets``: the packed sets of their shingles."""
    needed = materialize(buckets.select("item").distinct().join(one, "item").select(F.col("key").alias("_key"), F.col("item").alias("_item")), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, texts in slices(batch.column(0), SLICE_BYTES):
                same, _, shingles, count = shingle_sets(texts, words_per_shingle)
                wanted = batch.column(1).slice(at, len(texts)).to_numpy() == same
                ends = np.cumsum(count)
                found = [packed_set(shingles[ends[i] - count[i] : ends[i]]) for i in np.flatnonzero(wanted).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(same[wanted]), pa.array(found, pa.binary())], names=["item", "shingles"])

    texts = df.select(F.col(key).alias("_own"), utf8(text).alias("_text")).join(broadcast_if_few(needed), F.col("_own") == F.col("_key")).select("_text", "_item")
    return materialize(texts.mapInArrow(sets, "item long, shingles binary").dropDuplicates(["item"]), "shingles")


def _grouped(df: DataFrame, key: str, text: str, words_per_shingle: int, similarity: float | None) -> DataFrame:
    """Rows (key, text_hash, fp, first), one per row of ``df``; ``first`` (null_key, key, text_hash) is the least row of its component, null keys last."""
    prepare(df.sparkSession)
    make = fingerprints if similarity is None else _signatures
    rows = materialize(make(df, key, text, words_per_shingle), "fingerprints")
    least = F.min(F.struct(F.col("key").isNull().alias("null_key"), "key", "text_hash")).alias("least")
    nodes = materialize(rows.groupBy("fp").agg(least), "nodes")
    edges = links(nodes)
    if similarity is None:
        linked = materialize(components(edges), "linked")
    else:
        one = _distinct(rows)
        buckets = candidates(one)
        held = _shingles(df, one, buckets, key, text, words_per_shingle)
        linked = materialize(alike(one.select("item", "node"), buckets, held, similarity, edges), "linked")
    members = materialize(linked.join(nodes, linked.node == nodes.fp).select("fp", "root", "least"), "members")
    roots = materialize(members.groupBy("root").agg(F.min("least").alias("first")), "roots")
    far = members.join(roots, "root").select("fp", "first")
    known = materialize(nodes.join(far, "fp", "left").select("fp", F.coalesce("first", "least").alias("first")), "known")
    return rows.select("key", "text_hash", "fp").join(known, "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """Rows (key, fingerprint, component_id), one per row of ``df``.

    With ``similarity``, texts whose shingle sets have at least that Jaccard
    similarity are linked too: fingerprints of texts with a few changed words in
    a hundred differ in more bits than the grid can search.  Texts that share a
    MinHash band are verified, see ``similar``.

    ``component_id`` is the smallest key that can be reached over links of at
    most two differing bits, the row's own key included.  A null text has no
    words; texts without words have fingerprint 0 and are linked like others.
    Rows with equal keys are separate rows.  A null key is never a component's
    smallest key (null only where the whole component has null keys).  Extra
    columns are ignored.
    """
    found = _grouped(df, key, text, words_per_shingle, similarity)
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.key").alias("component_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest key stays.

    Rows are told apart by key and text: rows that share a key alone are judged
    each by its own text, and a null key is larger than all others.  Of several
    rows with that key the one whose text has the smallest hash stays, and of rows
    that share the text as well the one with the smallest hash of all columns.
    """
    found = materialize(_grouped(df, key, text, words_per_shingle, similarity).select("key", "text_hash", "first"), "groups")
    names = {x: free_name(df, x) for x in ("key", "text_hash")}
    named = lambda rows: broadcast_if_few(materialize(rows.select(*(F.col(x).alias(n) for x, n in names.items())).distinct(), "rows"))
    first = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = named(found.where(~first))
    repeated = named(found.where(first).groupBy("key", "text_hash").count().where("count > 1"))
    hashed = F.xxhash64(df[text])
    same = lambda rows: df[key].eqNullSafe(rows[names["key"]]) & (hashed == rows[names["text_hash"]])
    once = df.join(gone, same(gone), "left_anti").join(repeated, same(repeated), "left_anti")
    again = df.join(repeated, same(repeated), "left_semi").groupBy(key, F.xxhash64(text)).agg(F.min_by(F.struct(*own_columns(df)), row_hash(df)).alias("row"))
    return once.unionByName(again.select("row.*"))
