"""Benchmark decontamination with an FM-index per training shard.

The words of the benchmark are the alphabet.  Each task cuts its documents into
shards and keeps of a shard the runs of alphabet words that are long enough to
hold the shortest window; every other word only ends a run.  The runs are
suffix-sorted, and the Burrows-Wheeler text goes into a wavelet matrix.  The
windows of the benchmark are searched backwards, all at once and a word at a
time, by ranks in the matrix; the rows found are walked back to the nearest
sampled suffix, which gives their place, and the spans are merged by document.

The benchmark is a stated query set.  It is sent to the tasks in blocks of at
most ``BLOCK_WORDS`` words; with several blocks the spans of all blocks are
brought together by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary_views, broadcast_if_few, forget, free_name, materialize, prepare, utf8

WINDOW = 10
#: Benchmark words in one block, document words in one shard, and the distance of sampled suffix positions.
BLOCK_WORDS, SHARD_WORDS, SAMPLE = 4_000_000, 1_500_000, 8

#: Word bytes are 0-9, a-z after lower-casing A-Z, and all above 127; all others part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols in a text: a level of bits for each bit of a symbol, the highest first."""

    def __init__(self, text: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(text), bits, []
        for level in range(bits - 1, -1, -1):
            bit = (text >> level) & 1 == 1
            words = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bool)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            before = np.cumsum(ones, dtype=np.int32) - ones
            self.levels.append((words, before, self.n - int(ones.sum())))
            text = np.concatenate([text[~bit], text[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & low).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place beside it."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (words, before, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            l1, h1 = self._ones(words, before, low), self._ones(words, before, high)
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return high - low

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for words, before, zeros in self.levels:
            bit = (words[high >> 6] >> (high & 63).astype(np.uint64)) & np.uint64(1) == 1
            l1, h1 = self._ones(words, before, low), self._ones(words, before, high)
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
            symbol = symbol * 2 + bit
        return symbol, high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order; symbol 0 ends a run, and an earlier end is smaller than a later one.

    Prefixes are doubled, and only suffixes that are still tied are sorted again.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    held = rank[order]
    start = np.concatenate([[True], held[1:] != held[:-1]])
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    step, tied = 1, ~(start & np.append(start[1:], True))
    while tied.any():
        places = np.flatnonzero(tied)
        suffix = order[places]
        follows = suffix + step
        pair = (rank[suffix] << 32) | rank[np.minimum(follows, n - 1)]
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        order[places] = suffix
        start = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[suffix] = places[np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))]
        tied[places] = ~(start & np.append(start[1:], True))
        step *= 2
    return order


class FmIndex:
    """Backward search and location over runs of symbols, each ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(text)
        self.n = len(text)
        last = text[order - 1]
        self.matrix = WaveletMatrix(last.astype(np.int64), max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        kept = (order % sample == 0) | (last == 0)
        self.marks = np.packbits(np.append(kept, np.zeros(64 - self.n % 64, bool)), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.marks).astype(np.int64)
        self.marks_before = np.cumsum(ones) - ones
        self.samples = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each pattern; patterns are right-aligned, and a symbol below 1 is in no text."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            low[live] = self.before[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.matrix.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        out, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.marks[word] >> bit) & np.uint64(1) == 1
            low = (np.uint64(1) << bit[here]) - np.uint64(1)
            slot = self.marks_before[word[here]] + np.bitwise_count(self.marks[word[here]] & low).astype(np.int64)
            out[left[here]] = self.samples[slot] + steps
            left, at, steps = left[~here], at[~here], steps + 1
            symbol, rank = self.matrix.symbol_rank(at)
            at = self.before[symbol] + rank
        return out


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            own = words(text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.windows = list(owners)
        self.items = sorted({i for s in owners.values() for i in s if i is not None})
        number = {x: i for i, x in enumerate(self.items)}
        self.owners = [np.array(sorted(number[i] for i in s if i is not None), np.int64) for s in owners.values()]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for x in owners for w in x}))}
        self.lengths = np.array([len(x) for x in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.windows) else 0
        self.patterns = np.zeros((len(self.windows), window), np.int64)
        for i, x in enumerate(self.windows):
            self.patterns[i, window - len(x) :] = [self.ids[w] for w in x]

    def find(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard: document number, first word, and window number."""
        none = (np.zeros(0, np.int64),) * 3
        get = self.ids.get
        lengths = np.array([len(d) + 1 for d in documents], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat: list[int] = []
        for d in documents:
            flat.extend(map(get, d, repeat(0)))
            flat.append(0)
        text = np.array(flat, np.int32)
        if not self.windows or not len(text):
            return none
        ends = np.flatnonzero(text == 0)
        sizes = np.diff(ends, prepend=-1)
        keep = np.repeat(sizes > self.shortest, sizes)
        place = np.flatnonzero(keep)
        text = text[keep]
        if not len(text):
            return none
        index = FmIndex(text, len(self.ids))
        low, high = index.search(self.patterns, self.lengths)
        count = high - low
        found = np.flatnonzero(count > 0)
        if not len(found):
            return none
        count = count[found]
        rows = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = place[index.locate(rows)]
        document = np.searchsorted(starts, at, "right") - 1
        return document, at - starts[document], np.repeat(found, count)


def merged(document: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans merged where they meet or overlap: document, first word, word after the last."""
    if not len(document):
        return document, first, first
    by = np.lexsort((first, document))
    document, first, last = document[by], first[by], (first + length)[by]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(document * wide + last)
    new = np.concatenate([[True], document[1:] * wide + first[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return document[at], first[at], reach[np.append(at[1:], len(reach)) - 1] - document[at] * wide


def _spans(df: DataFrame, block: list[tuple[int | None, bytes]], key: str, text: str, extra: list[str], window: int) -> DataFrame:
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(Windows(block, window))
    rows = df.select(F.col(key).alias("key"), utf8(text).alias("text"), *extra)
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def report(batches: list[pa.RecordBatch], documents: list[list[bytes]]) -> pa.RecordBatch:
        windows = held.value
        document, first, which = windows.find(documents)
        d, a, b = merged(document, first, windows.lengths[which])
        spans: list[list] = [[] for _ in documents]
        for i, x, y in zip(d.tolist(), a.tolist(), b.tolist()):
            spans[i].append({"first": x, "end": y})
        items: list[list] = [[] for _ in documents]
        pairs = np.unique(np.stack([document, which]), axis=1) if len(document) else np.zeros((2, 0), np.int64)
        for i, w in zip(*pairs.tolist()):
            items[i] += windows.owners[w].tolist()
        ids = [[windows.items[j] for j in sorted(set(x))] for x in items]
        table = pa.Table.from_batches(batches).combine_chunks()
        size = pa.array([len(x) for x in documents], pa.int64())
        columns = [table["key"], size, pa.array(spans, span), pa.array(ids, pa.list_(pa.int64())), *(table[c] for c in extra)]
        return pa.table(columns, names=["key", "n_words", "spans", "items", *extra]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kept, documents, size = [], [], 0
        for batch in batches:
            at = 0
            found = [words(t) for t in binary_views(batch.column(1))]
            for i, x in enumerate(found):
                documents.append(x)
                size += len(x) + 1
                if size >= SHARD_WORDS:
                    yield from report([*kept, batch.slice(at, i + 1 - at)], documents)
                    kept, documents, size, at = [], [], 0, i + 1
            if at < len(batch):
                kept.append(batch.slice(at))
        if documents:
            yield from report(kept, documents)

    kinds = "".join(f", {c} {dict(df.dtypes)[c]}" for c in extra)
    return rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, n_words long, spans array<struct<first:long,end:long>>, items array<long>{kinds}")


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of a bounded number of words; one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("long").alias("item"), utf8(text).alias("text")).toLocalIterator():
        block.append((row["item"], bytes(row["text"])))
        size += len(words(block[-1][1]))
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, n_words, spans, items) and the columns ``extra``, one per row of ``documents``.

    ``spans`` are the merged word spans inside any occurrence of a window of an
    item: ``window`` consecutive words, or all words of an item that has fewer.
    ``items`` are the ids of the items with an occurring window, in ascending
    order.  Null texts have no words; items without words have no window; a null
    item id is not reported, though its windows count.  Equal items and repeated
    rows are handled on their own.  Other columns are ignored.
    """
    prepare(documents.sparkSession)
    extra = list(extra)
    blocks = iter(_blocks(benchmark, item, item_text))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _spans(documents, first, key, text, extra, window).withColumnRenamed("key", key)
    rows = materialize(documents.select(key, text, *extra, F.monotonically_increasing_id().alias("row_id")), "texts")
    found = None
    for block in (b for some in ([first, second], blocks) for b in some):
        part = materialize(_spans(rows, block, key, text, ["row_id", *extra], window), "spans")
        found = part if found is None else found.union(part)
    by_row = found.groupBy("row_id").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), *(F.first(c).alias(c) for c in extra),
    )

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), spans.value_lengths().to_numpy())
            first, end = (spans.flatten().field(i).to_numpy() for i in (0, 1))
            owner, first, end = merged(owner, first, end - first)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(batch)))]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(first), pa.array(end)], names=["first", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole, *batch.columns[3:]], names=["key", "n_words", "spans", "items", *extra])

    rows = by_row.drop("row_id")
    return rows.mapInArrow(together, rows.schema).withColumnRenamed("key", key)


def contamination_report(found: DataFrame) -> DataFrame:
    """What ``find_contamination`` found, as counts and a digest of the items."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("items_sha256", F.sha2(names.cast("binary"), 256)).withColumn("contaminated", F.col("n_hit") > 0).drop("spans", "items")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` whose text holds no window of the benchmark.  Rows with equal or null keys are judged each by its own text."""
    own, hashed = free_name(documents, "own"), free_name(documents, "text_hash")
    rows = documents.select(key, text, F.xxhash64(F.col(text)).alias("text_hash"))
    found = find_contamination(rows, benchmark, key, text, extra=("text_hash",), **options)
    bad = found.where(F.size("spans") > 0).select(F.col(key).alias(own), F.col("text_hash").alias(hashed)).distinct()
    bad = broadcast_if_few(materialize(bad, "contaminated"))
    return documents.join(bad, documents[key].eqNullSafe(bad[own]) & (F.xxhash64(documents[text]) == bad[hashed]), "left_anti")
