"""Near-duplicates by SuperMinHash signatures of word shingles.

An element of a set deals one rank to every slot of the signature: a random
permutation of the slots, with rank j plus a random fraction for the j-th of
them.  A slot holds the least value of all elements.  As an element's ranks are
all different, slots repeat each other less than those of independent MinHash
functions and the similarity estimate has a lower variance.  The ranks are dealt
level by level over all elements of many documents at once; a document is done
as soon as all its slots hold a value, since later levels only deal larger ones.

Documents whose signatures share a band are verified on their full sets, see
``similar``, and grouped into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import broadcast_if_few, forget, materialize, mix, prepare, utf8
from tessella.llm.similar import Words, alike, candidates, packed_set, slices, spread

#: Bands and slots a band: a pair of similarity 0.8 shares none with probability 0.00003.
BANDS, ROWS = 20, 4
#: Text bytes whose shingles are made at once.
SLICE_BYTES = 1 << 20
#: The value of a slot to which nothing has been dealt.
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, count: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of sets of ``count`` 64-bit elements each, one row of ``slots`` values for each set; an empty set leaves all of them unset."""
    out = np.full(len(count) * slots, UNSET, np.uint64)
    owner = np.repeat(np.arange(len(count)), count)
    order = None
    for level in range(slots):
        draw = mix(elements + mix(np.array([level + 1], np.uint64)))
        pick = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(elements))
        slot = pick if order is None else order[rows, pick].astype(np.int64)
        np.minimum.at(out, owner * slots + slot, (np.uint64(level) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_sets = (out.reshape(-1, slots) == UNSET).any(axis=1)
        stay = open_sets[owner]
        if not stay.any():
            break
        if order is None:
            order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (int(stay.sum()), slots)).copy()
        else:
            order = order[stay]
        elements, owner, pick = elements[stay], owner[stay], pick[stay]
        order[np.arange(len(elements)), pick] = order[:, level]
    return out.reshape(-1, slots)


def bands_of(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each run of ``rows`` slots, different for equal runs at different places."""
    out = np.zeros((len(signatures), signatures.shape[1] // rows), np.uint64)
    for band in range(out.shape[1]):
        own = np.full(len(signatures), band, np.uint64)
        for row in range(rows):
            own = mix(own ^ signatures[:, band * rows + row])
        out[:, band] = own
    return out


def distinct_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the different shingles of each text in order, and their number; all words are one shingle if there are fewer than ``n``."""
    words = Words(texts)
    first, size = words.texts[:-1], np.diff(words.texts)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    shingles = words.shingles(n)[spread(first, count)]
    short = np.flatnonzero((size > 0) & (size < n))
    starts = np.cumsum(count) - count
    for i in short.tolist():
        own = words.hashes[first[i] : first[i] + size[i]]
        shingles[starts[i]] = xxhash.xxh3_64_intdigest(own.tobytes(), n)
    owner = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(texts))


def _names(shingles: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    ends = np.cumsum(count)
    data = memoryview(np.ascontiguousarray(shingles)).cast("B")
    return np.array([xxhash.xxh3_64_intdigest(data[8 * (e - c) : 8 * e]) for e, c in zip(ends.tolist(), count.tolist())], np.uint64).view(np.int64)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text_hash, text); a null text counts as empty."""
    return df.select(df[key].cast("long").alias("key"), F.xxhash64(df[text]).alias("text_hash"), utf8(df[text]).alias("text"))


def signatures(df: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """Rows (key, text_hash, item, n, bands): the name and size of each row's set, and the bands of its signature; none for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                shingles, count = distinct_shingles(texts, words_per_shingle)
                bands = bands_of(super_minhash(shingles, count, BANDS * ROWS)[count > 0])
                offsets = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.view(np.int64).ravel()))
                columns = [*(c.slice(at, len(texts)) for c in batch.columns[:2]), pa.array(_names(shingles, count)), pa.array(count.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "item", "n", "bands"])

    return _rows(df, key, text).mapInArrow(run, "key long, text_hash long, item long, n long, bands array<long>")


def _sets(df: DataFrame, needed: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """Rows (item, shingles): the packed sets of ``needed`` (needed_key, needed_hash, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, texts in slices(batch.column(0), SLICE_BYTES):
                shingles, count = distinct_shingles(texts, words_per_shingle)
                ends = np.cumsum(count)
                found = [packed_set(shingles[e - c : e]) for e, c in zip(ends.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array(found, pa.binary())], names=["item", "shingles"])

    texts = _rows(df, key, text).join(broadcast_if_few(needed), F.col("key").eqNullSafe(F.col("needed_key")) & (F.col("text_hash") == F.col("needed_hash")))
    return materialize(texts.select("text", "item").mapInArrow(run, "item long, shingles binary").dropDuplicates(["item"]), "sets")


def shingle_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 2, similarity: float = 0.8) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one per row of ``df``.

    ``n_shingles`` is the number of different shingles of the whole text, A-Z
    lower-cased; a text of fewer words is one shingle.  Rows whose sets have at
    least the given Jaccard similarity are linked, if they share a band of their
    signatures; ``component_id`` is the smallest key that can be reached, the
    row's own included, and ``kept`` tells whether that is its own key.

    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing.  Rows with equal keys are separate rows; a null key is
    never a component's smallest key, so ``component_id`` is null only where all
    keys of a component are, and all those rows are kept.  Texts with equal sets
    stand for each other, so copies cost one row each.  Extra columns are ignored.
    """
    prepare(df.sparkSession)
    rows = materialize(signatures(df, key, text, words_per_shingle), "signatures")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")).alias("first")
    items = materialize(rows.where("n > 0").groupBy("item").agg(first, F.any_value("bands").alias("bands")), "items")
    buckets = candidates(items)
    shared = buckets.select("item").distinct().join(items.select("item", "first"), "item")
    needed = materialize(shared.select(F.col("first.key").alias("needed_key"), F.col("first.text_hash").alias("needed_hash"), "item"), "needed")
    linked = materialize(alike(None, buckets, _sets(df, needed, key, text, words_per_shingle), similarity), "linked")
    members = materialize(linked.select(F.col("node").alias("item"), "root").join(items.select("item", F.col("first.key").alias("least")), "item"), "members")
    roots = members.groupBy("root").agg(F.min("least").alias("component"))
    known = materialize(members.join(roots, "root").select("item", "component"), "components")
    alone = items.join(known, "item", "left_anti").select("item", F.col("first.key").alias("component"))
    named = materialize(known.union(alone), "named")
    out = rows.select("key", "item", "n").join(broadcast_if_few(named), "item", "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
