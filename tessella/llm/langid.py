"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes: for every context of up to ``ORDER``
bytes, how often each byte followed.  With the statistics frozen, a byte costs
-log2 of its share in the longest known context, where the number of distinct
followers is the weight of the escape to the next shorter context; below the
empty context all bytes cost the same.  The language whose tree gives the
shortest code for a whole text is the prediction.

The trees are fitted on a bounded sample: of each language at most about
``SAMPLE_DOCS`` labelled documents, those with the smallest hash of their key
and text.  Everything else looks at whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessella.llm.common import forget, free_name, prepare, utf8

#: Bytes of context, and the bound on the labelled documents of a language that the trees are fitted on.
ORDER, SAMPLE_DOCS = 3, 1_500
UNDETERMINED = "und"
#: Bytes that are scored at once, at about 100 bytes of memory each.
SLICE_BYTES = 1 << 20

_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)], np.uint8)


def _grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number that it and the ``order`` bytes before it make; a text begins as if after spaces."""
    out = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    for back in range(1, order + 1):
        before = np.full(len(data), 32, np.int64)
        before[back:] = data[:-back]
        before[place < back] = 32
        out |= before << (8 * back)
    return out


class Trees:
    """The context trees of all languages as cost tables."""

    def __init__(self, languages: list[str], grams: np.ndarray, owner: np.ndarray, counts: np.ndarray):
        """``grams`` of ``ORDER`` + 1 bytes, the number of their language, and how often they occur."""
        self.languages, n = languages, len(languages)
        symbols = np.unique(np.concatenate([(grams >> 8 * k) & 255 for k in range(ORDER + 1)] + [np.array([32])]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        self.base = base = len(symbols) + 1
        code = self._code(grams)
        #: tables[k]: seen codes of k + 1 symbols, and the cost of the last symbol after the others, by language.
        self.codes, self.costs, self.escapes = [], [], []
        for k in range(ORDER + 1):
            part = code % base ** (k + 1)
            seen, at = np.unique(part, return_inverse=True)
            table = np.zeros((len(seen), n))
            np.add.at(table, (at, owner), counts)
            context, where = np.unique(seen // base, return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, where, table)
            np.add.at(kinds, where, (table > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(table / (total + kinds)[where])
            shorter = self._lookup(k - 1, seen % base**k) if k else np.full((len(seen), n), 8.0)
            self.codes.append(seen)
            self.costs.append(np.where(table > 0, own, escape[where] + shorter).astype(np.float32))
            self.escapes.append((context, escape.astype(np.float32)))
        # A context of ORDER symbols that is known gets a number, and so does each byte after it.
        contexts = self.escapes[ORDER][0]
        self.context = np.zeros(base**ORDER, np.int32)
        self.context[contexts] = np.arange(1, len(contexts) + 1)
        self.row = np.zeros((len(contexts) + 1) * base, np.int32)
        self.row[self.context[self.codes[ORDER] // base] * base + self.codes[ORDER] % base] = np.arange(1, len(self.codes[ORDER]) + 1)
        self.known = np.concatenate([np.zeros((1, n), np.float32), self.costs[ORDER]])

    def _code(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            out = out * self.base + self.symbol[(grams >> 8 * k) & 255]
        return out

    def _lookup(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Costs of codes of k + 1 symbols, seen or not."""
        if k < 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        table, (contexts, escape) = self.codes[k], self.escapes[k]
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        hit = table[at] == codes
        out = np.empty((len(codes), len(self.languages)), np.float32)
        out[hit] = self.costs[k][at[hit]]
        miss = codes[~hit]
        if len(miss):
            above = np.minimum(np.searchsorted(contexts, miss // self.base), len(contexts) - 1)
            there = contexts[above] == miss // self.base
            out[~hit] = np.where(there[:, None], escape[above], 0) + self._lookup(k - 1, miss % self.base**k)
        return out

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; ``data`` holds the folded texts one after another, none of them empty."""
        symbols = self.symbol[data]
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        blank, code = self.symbol[32], np.zeros(len(data), np.int64)
        for back in range(ORDER, 0, -1):
            before = np.full(len(data), blank)
            before[back:] = symbols[:-back]
            before[place < back] = blank
            code = code * self.base + before
        row = self.row[self.context[code] * self.base + symbols]
        costs = self.known[row]
        new = np.flatnonzero(row == 0)
        if len(new):
            codes, at = np.unique(code[new] * self.base + symbols[new], return_inverse=True)
            costs[new] = self._lookup(ORDER, codes)[at]
        return np.add.reduceat(costs, starts, axis=0, dtype=np.float64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of a binary array without nulls, and where each text begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _LOWER[data], offsets - offsets[0]


def held_out(key: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its key as text, modulo 4, is 2.  A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Trees | None:
    """Trees from the rows of ``labelled`` with text and language; None if there are none.

    Counts of the sample are made in the executors; the driver gets them summed,
    at most one row for each language and distinct run of ``ORDER`` + 1 bytes.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return None
    prepare(spark)
    languages = sorted(sizes)
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1_000_003)) / 1_000_003.0
    limit = F.lit(0.0)
    for name in languages:
        limit = F.when(F.col(lang) == name, min(1.0, sample_docs / sizes[name])).otherwise(limit)
    sample = rows.where(share < limit).select(F.col(lang).alias("lang"), utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                own = batch.column(1).filter(pa.array(names == name))
                data, starts = _texts(own)
                grams, counts = np.unique(_grams(data, starts[:-1], ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not len(counts):
        return None
    number = {x: i for i, x in enumerate(languages)}
    owner = np.array([number[x] for x in counts["lang"].to_pylist()])
    present = sorted(set(owner))
    again = {x: i for i, x in enumerate(present)}
    owner = np.array([again[x] for x in owner])
    return Trees([languages[x] for x in present], counts["gram"].to_numpy(), owner, counts["n"].to_numpy().astype(float))


def identify(df: DataFrame, trees: Trees | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the columns ``pred`` and ``score``, in the place of any with these names.

    ``score`` is the share of the predicted language in the sum of 2 to the power
    of minus the code length.  A text that is null or has no letter is ``und``
    with score 0, and so is every text if there is nothing to learn from.  Equal
    code lengths go to the language whose name is smaller.
    """
    df = df.drop(*(c for c in df.columns if c in (pred, score)))
    if trees is None:
        return df.withColumn(pred, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    prepare(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(trees)
    fields = df.columns
    flag = free_name(df, "letters")

    def predict(batch: pa.RecordBatch) -> tuple[list[str], list[float]]:
        model = held.value
        names, scores = [UNDETERMINED] * len(batch), [0.0] * len(batch)
        live = np.flatnonzero(batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False))
        texts = batch.column(batch.schema.get_field_index(text)).take(pa.array(live)).cast(pa.binary())
        folded, starts = _texts(texts)
        at = 0
        while at < len(live):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES, "right")) - 1)
            to = min(to, len(live))
            bits = model.code_lengths(folded[starts[at] : starts[to]], starts[at:to] - starts[at])
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
            for i, b, s in zip(live[at:to].tolist(), best.tolist(), share.tolist()):
                names[i], scores[i] = model.languages[b], s
            at = to
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names, scores = predict(batch)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*fields, pred, score])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    schema = StructType([*df.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return df.withColumn(flag, letters).mapInArrow(run, schema)


def language_report(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (key, held_out, lang_pred, score), one per row; learns from rows that are not held out."""
    learn = documents.where(~held_out(key) & F.col(key).isNotNull())
    trees = fit(learn, text, lang, key, sample_docs)
    rows = documents.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("__text"))
    return identify(rows, trees, "__text").drop("__text")


def keep_identified(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose language is identified with a score of ``least`` or more."""
    trees = fit(documents.where(~held_out(key) & F.col(key).isNotNull()), text, lang, key)
    pred, score = free_name(documents, "lang_pred"), free_name(documents, "score")
    found = identify(documents, trees, text, pred, score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).drop(pred, score)
