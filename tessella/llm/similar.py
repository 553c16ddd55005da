"""Linking items whose sets of word shingles are alike, without a pair of items more than once in a task.

Items that share a MinHash band are candidates.  They are verified by the exact
Jaccard similarity of their sets, first against the most central item of each
band, and then every pair of a band that is not in one class yet, in pairs of
blocks of bounded size.  A set is held as the 32-bit hashes of its shingles; two
different shingles of a pair share one with probability below n**2 / 2**32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary_views, broadcast_if_few, materialize, mix
from tessella.llm.components import components

#: MinHash bands and rows a band: a pair of similarity 0.8 shares none with probability 0.0002.
BANDS, ROWS = 16, 4
#: Bytes of shingle hashes in a block of a band's items.
BLOCK_BYTES = 2 << 20
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


class Words:
    """The words of a few texts, one after another: a hash of each, and where lines and texts begin.

    Words are parted by ASCII white space, A-Z lower-cased; lines by ``\\n``.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).lower()
        lowered = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data)])
        lines = pc.split_pattern(lowered, "\n")
        chunks = pc.ascii_split_whitespace(lines.flatten())
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        each = np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], np.uint64)
        code = coded.indices.to_numpy()
        real = np.array([w != "" for w in words] or [False])[code]
        before = np.concatenate([[0], np.cumsum(real)])
        self.hashes = each[code[real]]
        #: First word of each line, and of each text, with the number of words at the end.
        self.lines = before[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        self.line_of_text = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        self.texts = self.lines[self.line_of_text]

    def shingles(self, n: int) -> np.ndarray:
        """A hash of the ``n`` words from each place on; those that begin less than ``n`` words before the end are no shingles."""
        out = np.zeros(len(self.hashes), np.uint64)
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        for i in range(n):
            out = mix(out ^ padded[i : i + len(out)])
        return out


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in slices of about ``most`` bytes, with the number of the first text of each."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")) - at)
        yield at, texts.slice(at, n)
        at += n


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each range, one range after another."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def minhash_bands(shingles: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bands of sets of ``count`` shingles each (one at least), one row for each set."""
    out = np.zeros((len(count), BANDS), np.uint64)
    if len(count):
        starts = np.cumsum(count) - count
        for band in range(BANDS):
            own = np.full(len(count), band, np.uint64)
            for row in range(ROWS):
                own = mix(own ^ np.minimum.reduceat(shingles * _FACTORS[band * ROWS + row], starts))
            out[:, band] = own
    return out


def packed_set(shingles: np.ndarray) -> bytes:
    return np.unique((shingles >> np.uint64(32)).astype("<u4")).tobytes()


def candidates(items: DataFrame) -> DataFrame:
    """Rows (band, item, n) for the bands that n > 1 of the ``items`` (item, bands; distinct) share."""
    banded = items.select("item", F.explode("bands").alias("band"))
    sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    return materialize(banded.join(broadcast_if_few(sizes), "band").select("band", "item", "n"), "buckets")


def _central(nodes: DataFrame | None, buckets: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between the nodes of alike items, each item against the most central one of a band they share.

    An item is the more central the more items its bands hold: the original of
    many copies that were edited apart shares most bands with most of them.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(binary_views(batch.column(2)), binary_views(batch.column(3))):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["item", "low"]).filter(pa.array(keep, pa.bool_()))

    weights = broadcast_if_few(materialize(buckets.groupBy("item").agg(F.sum("n").alias("weight")), "weights"))
    first = buckets.join(weights, "item").groupBy("band").agg(F.max_by("item", F.struct("weight", "item")).alias("low"))
    pairs = buckets.join(broadcast_if_few(materialize(first, "first")), "band").where("item <> low").select("item", "low").distinct()
    other = held.select(F.col("item").alias("low"), F.col("shingles").alias("others"))
    checked = materialize(pairs, "pairs").join(held, "item").join(other, "low").select("item", "low", "shingles", "others").mapInArrow(verify, "item long, low long")
    if nodes is None:
        return checked.toDF("a", "b")
    found = checked.join(nodes, "item").withColumnRenamed("node", "a").join(nodes.toDF("low", "b"), "low")
    return found.where("a <> b").select("a", "b")


def _overlaps(sets: list[np.ndarray], classes: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that link all classes of ``classes`` with alike sets (without repeats); if there are two ``sides``, pairs across them."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    held, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    label, out = np.unique(classes, return_inverse=True)[1], []
    asked = np.full(len(sets), sides.min() == sides.max()) | (sides == sides.max())
    for i in np.flatnonzero(sides == sides.min()).tolist():
        if (label[asked] == label[i]).all():
            continue
        own = token[begins[i] : begins[i + 1]]
        counts = starts[own + 1] - starts[own]
        both = np.bincount(held[spread(starts[own], counts)], minlength=len(sets))
        for j in np.flatnonzero((both >= similarity * (sizes + sizes[i] - both)) & asked & (label != label[i])).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _rest(nodes: DataFrame | None, buckets: DataFrame, held: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between the classes of alike items that share a band; ``classes`` (node, class) are those linked so far.

    Every pair of different classes in a band is looked at.  The items of a band
    are dealt to blocks of about ``BLOCK_BYTES`` bytes of shingles, and each pair of
    blocks is a group of its own, so no task holds a whole band.
    """
    sized = held.select("item", F.length("shingles").cast("long").alias("bytes"))
    sized = sized.withColumn("node", F.col("item")) if nodes is None else sized.join(nodes, "item")
    sized = sized.join(broadcast_if_few(classes), "node", "left").select("item", "bytes", F.coalesce("class", "node").alias("class"))
    members = materialize(buckets.select("band", "item").join(broadcast_if_few(materialize(sized, "classes")), "item"), "members")
    mixed = members.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("set"))
    mixed = mixed.where("low < high").groupBy("n", "bytes", "set").agg(F.min("band").alias("band"))
    blocks = materialize(mixed.select("band", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks")), "blocks")
    dealt = members.join(broadcast_if_few(blocks), "band").withColumn("own", F.pmod(F.xxhash64("item", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("item", "class", "band", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        found, classes = [], group["class"].to_numpy()
        if len(group) > 1 and (classes != classes[0]).any():
            found = _overlaps([np.frombuffer(x, "<u4") for x in group["shingles"].to_pylist()], classes, group["own"].to_numpy(), similarity)
        ends = [pa.array(np.array([classes[p[side]] for p in found], np.int64)) for side in (0, 1)]
        return pa.Table.from_arrays(ends, names=["a", "b"])

    pairs = materialize(dealt, "dealt").join(held, "item").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")
    return pairs.where("a <> b").distinct()


def alike(nodes: DataFrame | None, buckets: DataFrame, held: DataFrame, similarity: float, edges: DataFrame | None = None) -> DataFrame:
    """Rows (node, root) for all nodes that are linked: through alike items that share a band, and over ``edges`` (a, b).

    ``nodes`` (item, node) names the node of every item of ``buckets`` (from
    ``candidates``), by default itself; ``held`` (item, shingles) has their packed sets.
    """
    found = _central(nodes, buckets, held, similarity)
    linked = materialize(components(materialize(found if edges is None else edges.union(found), "first-edges")), "linked")
    classes = linked.select("node", F.col("root").alias("class"))
    more = materialize(_rest(nodes, buckets, held, classes, similarity), "more-edges")
    if not more.head(1):
        return linked
    joined = materialize(components(more).withColumnRenamed("root", "top"), "joined")  # between classes, each named by its smallest node
    ends = linked.join(broadcast_if_few(joined.toDF("root", "top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return ends.unionByName(joined.join(linked.select("node"), "node", "left_anti").select("node", F.col("top").alias("root")))
