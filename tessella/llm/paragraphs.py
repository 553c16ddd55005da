"""Repeated passages by MinHash over paragraphs, and over pieces of them.

Paragraphs are lines of at least ``LEAST`` words.  Their 5-word shingles are
MinHashed in bands, paragraphs that collide are verified by the exact Jaccard
similarity of their shingles (see ``similar``), and alike ones are clustered by
connected components.

A passage may also stand in the middle of paragraphs that are otherwise unlike.
So texts are cut into overlapping pieces of ``PIECE`` words that begin where the
content says: at every place whose 5-word shingle has the smallest hash of some
``SPAN`` places in a row.  That smallest hash is the MinHash of the places around
it, so two texts that share ``SPAN`` shingles in a row share such places, wherever
in their lines the passage stands, and equal pieces are a cluster.

A cluster stays in its smallest document key and is removed from the others.
The texts are read twice by Python: once for all paragraphs and pieces, and once
for the shingles of the paragraphs that collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import similar
from tessella.llm.common import WORD, broadcast_if_few, free_name, materialize, mix, prepare, utf8
from tessella.llm.similar import Words, alike, candidates, minhash_bands, packed_set, slices, spread

#: Words of a shingle, of a piece, and of the shortest paragraph; and places of which the smallest hash begins a piece.
#: A common passage of ``SPAN + PIECE - 1`` = 51 words has a whole window of places that begin a piece inside it, so it shares a piece.
SHINGLE, PIECE, LEAST, SPAN = 5, 34, 34, 18
SIMILARITY = 0.8
#: Text bytes that are cut at once, and document keys and paragraphs that are broadcast at most.
SLICE_BYTES, MAX_BROADCAST_BYTES = 1 << 20, 32 << 20


def anchors(shingles: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places that have the smallest hash of some ``SPAN`` places in a row of a text (the last of equal ones) and a whole piece after them.

    ``texts`` has the first word of each text and the number of all words.
    """
    n = len(shingles)
    if n < SPAN + SHINGLE - 1:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    least = (shingles & ~low) | (low - np.arange(n, dtype=np.uint64))
    width = 1
    while 2 * width <= SPAN:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < SPAN:
        least = np.minimum(least[: width - SPAN], least[SPAN - width :])
    end = np.repeat(texts[1:], np.diff(texts))
    begins = np.arange(len(least))
    places = np.unique((low - (least[begins + SPAN + SHINGLE - 1 <= end[: len(least)]] & low)).astype(np.int64))
    return places[places + PIECE <= end[places]]


def piece_hashes(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of all words of each piece, from shingles that cover it."""
    out = np.zeros(len(at), np.uint64)
    for i in (*range(0, PIECE - SHINGLE, SHINGLE), PIECE - SHINGLE):
        out = mix(out ^ shingles[at + i])
    return out


def paragraph_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of all words of each paragraph: of their sum, each weighed by its place."""
    out = np.zeros(len(first), np.uint64)
    if len(first):
        place = spread(np.zeros(len(first), np.int64), size).astype(np.uint64)
        out = mix(np.add.reduceat(mix(words[spread(first, size)] ^ mix(place + np.uint64(1))), np.cumsum(size) - size) ^ size.astype(np.uint64))
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (item, key, first, size, bands) of ``rows`` (key, text): its pieces, without bands, and its paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                words = Words(texts)
                shingles = words.shingles(SHINGLE)
                size = np.diff(words.lines)
                long = size >= LEAST
                paragraphs, size = words.lines[:-1][long], size[long]
                pieces = anchors(shingles, words.texts)
                first = np.concatenate([paragraphs, pieces])
                owner = np.searchsorted(words.texts, first, "right") - 1
                item = np.concatenate([paragraph_hashes(words.hashes, paragraphs, size), piece_hashes(shingles, pieces)])
                bands = minhash_bands(shingles[spread(paragraphs, size - SHINGLE + 1)], size - SHINGLE + 1)
                ends = np.minimum(np.arange(len(first) + 1), len(paragraphs)) * similar.BANDS
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bands.view(np.int64).ravel()))
                sizes = np.concatenate([size, np.full(len(pieces), PIECE)]).astype(np.int32)
                columns = [pa.array(item.view(np.int64)), batch.column(0).take(pa.array(at + owner)), pa.array((first - words.texts[owner]).astype(np.int32)), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "key", "first", "size", "bands"])

    return rows.mapInArrow(run, "item long, key long, first int, size int, bands array<long>")


def _held(rows: DataFrame, paragraphs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (item, shingles) of the paragraphs (item, key, first, size) in ``buckets``."""
    wanted = buckets.select("item").distinct().join(paragraphs, "item").groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("item", "first", "size")).alias("at"))
    wanted = materialize(wanted, "wanted")
    n, places = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    wanted = F.broadcast(wanted) if 8 * n + 16 * places <= MAX_BROADCAST_BYTES else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(0), SLICE_BYTES):
                words = Words(texts)
                shingles = words.shingles(SHINGLE)
                lists = batch.column(1).slice(at, len(texts))
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                item, first, size = (lists.flatten().field(i).to_numpy() for i in range(3))
                first = words.texts[owner] + first
                there = first + size <= words.texts[owner + 1]  # another row with the same key may have another text
                item, first, size = item[there], first[there], size[there].astype(np.int64)
                same = paragraph_hashes(words.hashes, first, size) == item.view(np.uint64)
                found = [packed_set(shingles[a : a + n - SHINGLE + 1]) for a, n in zip(first[same].tolist(), size[same].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(item[same]), pa.array(found, pa.binary())], names=["item", "shingles"])

    texts = rows.join(wanted, F.col("key") == F.col("of")).select("text", "at")
    return materialize(texts.mapInArrow(sets, "item long, shingles binary").dropDuplicates(["item"]), "shingles")


def merged_spans(spans: list[tuple[int, int, bool]]) -> list[list]:
    """Disjoint spans [first, end, stays] of the words under ``spans`` (first word, word after the last, whether it stays), in order.

    A word under a span that stays, stays, also where one that goes covers it.
    """
    out: list[list] = []
    kept: list[list] = []
    for first, end, stays in sorted(spans):
        if stays:
            if kept and kept[-1][1] >= first:
                kept[-1][1] = max(kept[-1][1], end)
            else:
                kept.append([first, end, True])
    gone = sorted((a, b) for a, b, stays in spans if not stays)
    edge, at = 0, 0
    for first, end in gone:
        first = max(first, edge)
        while at < len(kept) and kept[at][1] <= first:
            at += 1
        k = at
        while first < end:
            until = min(end, kept[k][0]) if k < len(kept) else end
            if first < until:
                if out and out[-1][1] == first:
                    out[-1][1] = until
                else:
                    out.append([first, until, False])
            if k == len(kept):
                break
            first, k = max(first, kept[k][1]), k + 1
        edge = max(edge, end)
    return sorted(out + kept)


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, spans): for each document with passages that repeat in another one, the disjoint word spans and whether each stays.

    ``spans`` holds first word, word after the last, and ``stays``: whether it is
    under a paragraph or piece that has its cluster's smallest key here.
    """
    prepare(df.sparkSession)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"))
    cut = materialize(_cut(rows), "cut")
    is_piece = F.size("bands") == 0
    several = lambda low, high: F.col(low) < F.col(high)
    pieces = cut.where(is_piece).select("item", "key", "first")
    clusters = materialize(pieces.groupBy("item").agg(F.min("key").alias("least"), F.max("key").alias("most")).where(several("least", "most")).drop("most"), "pieces")
    spans = pieces.join(clusters, "item").select("key", "first", (F.col("first") + PIECE).alias("end"), (F.col("key") == F.col("least")).alias("stays"))

    lines = cut.where(~is_piece)
    one = lines.groupBy("item").agg(F.min(F.struct("key", "first", "size")).alias("at"), F.max("key").alias("most"), F.any_value("bands").alias("bands"))
    one = materialize(one.select("item", F.col("at.key").alias("key"), F.col("at.first").alias("first"), F.col("at.size").alias("size"), "most", "bands"), "paragraphs")
    buckets = candidates(one)
    held = _held(rows, one.select("item", "key", "first", "size"), buckets)
    linked = materialize(alike(None, buckets, held, SIMILARITY), "linked")
    members = one.select("item", "key", "most").join(linked, one["item"] == linked["node"], "left").select("item", F.coalesce("root", "item").alias("root"), "key", "most")
    members = materialize(members, "members")
    roots = members.groupBy("root").agg(F.min("key").alias("least"), F.max("most").alias("last")).where(several("least", "last")).select("root", "least")
    known = materialize(members.join(broadcast_if_few(materialize(roots, "roots")), "root").select("item", "least"), "repeated")
    whole = lines.join(broadcast_if_few(known), "item").select("key", "first", (F.col("first") + F.col("size")).alias("end"), (F.col("key") == F.col("least")).alias("stays"))

    listed = spans.unionByName(whole).groupBy("key").agg(F.collect_list(F.struct("first", "end", "stays")).alias("at"))
    kind = "array<struct<first:int,end:int,stays:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, at = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten()
            columns = (np.split(at.field(i).to_numpy(zero_copy_only=False), ends[:-1]) for i in range(3))
            merged = [merged_spans(list(zip(*(c.tolist() for c in own)))) for own in zip(*columns)]
            first, end, keep = (pa.array([x[i] for own in merged for x in own], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_())))
            offsets = pa.array(np.cumsum([0, *map(len, merged)]).astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([first, end, keep], names=["first", "end", "stays"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["key", "spans"])

    return listed.mapInArrow(run, f"key long, spans {kind}").withColumnRenamed("key", key)


def passage_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, repeated, n_spans, n_repeated, n_removed), one per row of ``df``.

    A repeat is a paragraph of at least ``LEAST`` words that another document has
    with a similarity of 0.8 or more, or ``PIECE`` words in a row that another
    document has word for word.  ``n_spans`` counts runs of such words.
    ``n_removed`` counts the words of repeats that stay in a smaller document key,
    and in none that stays here.  Null, empty and short texts have no repeats;
    rows with equal keys are one document, and a null key has none.  Extra columns
    are ignored.
    """
    found = materialize(repeated_passages(df, key, text), "repeats")
    words = lambda cond: F.aggregate(F.filter("spans", cond), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    runs = F.size(F.filter("spans", lambda s, i: (i == 0) | (F.get("spans", i - 1)["end"] < s["first"])))
    found = found.select(F.col(key).alias("_own"), runs.cast("long").alias("n_spans"), words(lambda s: F.lit(True)).alias("n_repeated"), words(lambda s: ~s["stays"]).alias("n_removed"))
    out = df.select(F.col(key).alias("_key")).join(found, F.col("_key") == F.col("_own"), "left").na.fill(0, ["n_spans", "n_repeated", "n_removed"])
    return out.select(F.col("_key").alias(key), (F.col("n_spans") > 0).alias("repeated"), "n_spans", "n_repeated", "n_removed")


def drop_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with the words of removed repeats taken out of ``text``; texts without any stay as they are."""
    found = materialize(repeated_passages(df, key, text), "repeats")
    own, gone = free_name(df, "key"), free_name(df, "gone")
    found = found.select(F.col(key).alias(own), F.filter("spans", lambda s: ~s["stays"]).alias(gone)).where(F.size(gone) > 0)
    joined = df.join(found, df[key] == found[own], "left")
    kept = F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w, i: ~F.exists(gone, lambda s: (i >= s["first"]) & (i < s["end"])))
    cut = F.when(F.col(gone).isNotNull(), F.array_join(kept, " ")).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*df.columns)
