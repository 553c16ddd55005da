"""Token-id shards with a minimal-perfect-hash index for keyed access.

A data set is a folder.  ``shard-R-F.ids`` holds raw token ids, documents one
after another, in 2 or 4 bytes (little-endian).  ``shard-R-F.idx`` holds the
document keys in file order, the offset of each document, and the minimal
perfect hash with, for every slot, a fingerprint of the key, the first document
of that key and the number of its documents.  ``manifest`` is a Parquet table
with a row per shard file.  Range R holds smaller keys than range R + 1, and
files of a range follow each other, so the files in order hold the documents in
ascending key order, null keys first.

Defined results: a null text is an empty document (only its end id); documents
of one key are kept side by side, ordered by their ids; an empty table gives a
data set without shards.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import file_system, fresh_path, mix, read_file, prepare, utf8, worker_caches, write_file
from tessella.llm.mphf import MinimalPerfectHash

MANIFEST = "range int, file int, name string, docs long, tokens long, width int, null_keys long, min_key long, max_key long"
#: Text bytes that a shard range aims at, and the most ranges.
RANGE_BYTES, MAX_RANGES = 32 << 20, 20_000
#: A shard file is closed once it holds so many ids.
FILE_IDS = 64 << 20
#: Text bytes that are split at once, and chunks that a worker remembers.
SLICE_BYTES, REMEMBERED = 16 << 20, 600_000


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file.

    If the tokenizer drops all white space before it looks at words, the ids of
    a text are the ids of its white-space-separated chunks one after another;
    then each distinct chunk is encoded once and remembered.  If it also sets a
    last full stop or comma apart, or lowers letters, chunks that differ in these
    alone are encoded once.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = drops_white_space(spec)
        self.sets_apart, self.lowers = sets_ends_apart(spec), lowers_letters(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text and ``end_id``, as bytes of ``dtype``."""
        end = np.array([end_id], self.dtype).tobytes()
        if not self.by_chunk:
            return [x + end for x in self._ids(texts.to_pylist())]
        out: list[bytes] = []
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, "right")))
            out += self._encode_slice(texts.slice(at, n), end)
            at += n
        return out

    def _encode_slice(self, texts: pa.Array, end: bytes) -> list[bytes]:
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        if self.lowers:
            words = [w[0].lower() + w[1:] if "A" <= w[:1] <= "Z" else w for w in words]
        last = [w[-1] if self.sets_apart and w.endswith((".", ",")) and w[-2:-1].isascii() and w[-2:-1].isalnum() else "" for w in words]
        words = [w[:-1] if e else w for w, e in zip(words, last)]
        new = list({w: None for w in words if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(words))
        known.update(zip(new, self._ids(new)))
        ends_with = dict(zip(".,", self._ids([".", ","])))
        ids = [known[w] + ends_with[e] if e else known[w] for w, e in zip(words, last)]
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        starts = flat.buffers()[1]
        offsets = np.frombuffer(starts, np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = memoryview(flat.buffers()[2]) if len(flat) and flat.buffers()[2] else memoryview(b"")
        cut = np.concatenate([[0], offsets[ends]]).tolist()
        return [bytes(data[a:b]) + end for a, b in zip(cut, cut[1:])]


def drops_white_space(spec: dict) -> bool:
    """Whether no id of this tokenizer can depend on, or span, white space."""
    if spec.get("truncation") or spec.get("padding"):
        return False
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    kinds = [x["type"] for x in normal.get("normalizers", [normal])]
    if not set(kinds) <= {"NFC", "NFKC", "Lowercase", "Replace"}:
        return False
    replaced = [x for x in normal.get("normalizers", [normal]) if x["type"] == "Replace"]
    if any(x["pattern"] != {"Regex": "\\s+"} or x["content"] != " " for x in replaced):
        return False
    pre = spec.get("pre_tokenizer") or {"type": None}
    first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
    if first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer"):
        return True
    pattern = first["pattern"].get("Regex", "") if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] else ""
    rest = pattern.replace("[^\\s\\p{L}\\p{N}]", "")  # what is left may match or look at white space in none of these ways
    return rest != pattern and not any(x in rest for x in (" ", ".", "[^", "\\s", "\\S", "\\r", "\\n", "\\t", "\\P", "\\W", "\\D", "\\Z", "\\b", "\\x", "\\u", "$", "^"))


#: A pattern that ends a piece between a letter or digit and what is neither.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def sets_ends_apart(spec: dict) -> bool:
    """Whether a full stop or comma that ends a chunk after an ASCII letter or digit has ids of its own, whatever is before it."""
    pre = spec.get("pre_tokenizer") or {"type": None}
    first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
    splits = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"] == {"Regex": PIECES}
    return splits and not any(c in x["content"] for x in spec.get("added_tokens") or [] for c in ".,")


def lowers_letters(spec: dict) -> bool:
    """Whether a chunk has the same ids if its first letter, of A to Z, is lowered."""
    normal = spec.get("normalizer") or {"type": None}
    lowered = any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal]))
    return lowered and not any(x["content"][:1].isalpha() for x in spec.get("added_tokens") or [])


_encoders: dict[str, Encoder] = {}
worker_caches.append(_encoders)


def encoder(path: str) -> Encoder:
    """The worker's encoder; workers are used for many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ranges(df: DataFrame, key: str, text: str) -> list[int]:
    """Smallest keys of the ranges but the first, from exact counts of bytes and near quantiles of keys."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(min(MAX_RANGES, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10 * n + 1000)).first()[0]
    return sorted({int(x) for x in cuts or []})


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", cuts: list[int] | None = None) -> DataFrame:
    """Rows (range, key, ids): the ids of each whole text with ``end_id``."""
    prepare(df.sparkSession)
    bounds = np.array(cuts or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            found = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            ids = coder.encode(batch.column(1).cast(pa.string()), end_id)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), keys, pa.array(ids, pa.binary())], names=["range", "key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text")).mapInArrow(run, "range int, key long, ids binary")


def _index(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """The index file of one shard; ``keys`` are sorted, null keys first."""
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]))
    docs = np.diff(np.append(first, len(keys)))
    a, b = keys[first].view(np.uint64), null[first].astype(np.uint64)
    table = MinimalPerfectHash.build(a, b)
    slot = table.slots(a, b)
    order = np.argsort(slot)
    code = table.to_bytes()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    parts = [fingerprint(a, b)[order].astype("<u4"), first[order].astype("<u4"), docs[order].astype("<u4"), keys.astype("<i8"), np.packbits(null), offsets]
    return struct.pack("<3Q", len(keys), len(first), len(code)) + code + b"".join(x.tobytes() for x in parts)


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(mix(a) + b) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """The index of one shard file: constant-time access by key."""

    def __init__(self, data: bytes):
        self.docs, self.distinct, code = struct.unpack_from("<3Q", data)
        at = 24 + code
        self.hash = MinimalPerfectHash.from_bytes(data[24:at])

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.prints, self.first, self.count = (take("<u4", self.distinct) for _ in range(3))
        self.keys = take("<i8", self.docs)
        self.null = np.unpackbits(take("u1", -(-self.docs // 8)), count=self.docs).astype(bool)
        self.offsets = take("<u8", self.docs + 1).astype(np.int64)

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; number 0 where the key is absent."""
        a, b = keys.astype(np.int64).view(np.uint64), null.astype(np.uint64)
        slot = self.hash.slots(a, b)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprint(a[there], b[there])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], count[there] = self.first[slot[there]], self.count[slot[there]]
        return first, count


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``df`` and write it as shards under ``path``; returns the manifest.

    Each range is one task, sorted on disk where it does not fit in memory.
    Token ids, not texts, are shuffled.
    """
    cuts = _ranges(df, key, text)
    coded = encode_documents(df, tokenizer, end_id, key, text, cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).width
        part, files, kept = None, 0, []

        def close() -> pa.RecordBatch:
            keys = pa.concat_arrays([x.column(1) for x in kept])
            null = keys.is_null().to_numpy(zero_copy_only=False)
            plain = keys.fill_null(0).to_numpy(zero_copy_only=False)
            lengths = np.concatenate([pc.binary_length(x.column(2)).to_numpy(zero_copy_only=False) for x in kept]) // width
            name = f"shard-{part:05d}-{files:04d}"
            write_file(f"{path}/{name}.idx", _index(plain, null, lengths))
            write_file(f"{path}/{name}.ids", *(b"".join(x.column(2).to_pylist()) for x in kept))
            row = [part, files, name, len(keys), int(lengths.sum()), width, int(null.sum()), pc.min(keys).as_py(), pc.max(keys).as_py()]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            kept.append(batch)
            size += pc.sum(pc.binary_length(batch.column(2))).as_py() // width
            if size >= FILE_IDS:
                yield close()
                files, kept, size = files + 1, [], 0
        if kept:
            yield close()

    rows = coded.repartitionById(len(cuts) + 1, "range").sortWithinPartitions(F.asc_nulls_first("key"), "ids").mapInArrow(run, MANIFEST)
    rows.write.parquet(f"{path}/manifest")
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shard files with ``number`` from 0 and ``start``, the ids in all files before each. It has one row per file of up to 64 M ids."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    ordered = Window.orderBy("range", "file")
    before = F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("number", F.row_number().over(ordered) - 1).withColumn("start", F.coalesce(before, F.lit(0)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: key, start, n_tokens, ids_crc32 and shard.

    Each distinct key is looked up in its shard's index, and the documents are
    read at the offsets that the index gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = ShardIndex(read_file(f"{path}/{row['name']}.idx"))
                ids = np.frombuffer(read_file(f"{path}/{row['name']}.ids"), f"<u{row['width']}")
                head = np.flatnonzero(np.concatenate([[True], (index.keys[1:] != index.keys[:-1]) | (index.null[1:] != index.null[:-1])]))
                first, count = index.find(index.keys[head], index.null[head])
                place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                if len(place) != index.docs:
                    raise ValueError(f"{path}/{row['name']}.idx does not fit its shard")
                begin, end = index.offsets[place], index.offsets[place + 1]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begin.tolist(), end.tolist())]
                columns = [pa.array(index.keys[place], mask=index.null[place]), pa.array(begin + row["start"]), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array([row["name"]] * len(crc), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "shard"])

    files = manifest(spark, path).select("name", "width", "number", "start")
    n = max(1, min(10_000, files.count()))
    return files.repartitionById(n, F.col("number") % n).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long, shard string")


class TokenStore:
    """Keyed access from one process: the ids of a document without a scan.

    The file is found by binary search over the key ranges of the files.  Of its
    index only the hash is read, once; a look-up reads the slot's fingerprint and
    place, two offsets and the ids, each at its own place in the files.
    """

    def __init__(self, spark: SparkSession, path: str, remembered: int = 64):
        self.path, self.remembered = path, remembered
        rows = sorted(manifest(spark, path).collect(), key=lambda r: (r["range"], r["file"]))
        self.with_null = [r for r in rows if r["null_keys"]]
        self.files = [r for r in rows if r["min_key"] is not None]
        self.ends = [r["max_key"] for r in self.files]
        self.hashes: dict[str, tuple] = {}

    @staticmethod
    def _at(file, kind: str, place: int, n: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize
        file.seek(place)
        return np.frombuffer(file.read(size * n), kind)

    def _hash(self, name: str, file) -> tuple:
        if name not in self.hashes:
            if len(self.hashes) >= self.remembered:
                self.hashes.pop(next(iter(self.hashes)))
            docs, distinct, code = self._at(file, "<u8", 0, 3).tolist()
            self.hashes[name] = (docs, distinct, 24 + code, MinimalPerfectHash.from_bytes(self._at(file, "u1", 24, code).tobytes()))
        return self.hashes[name]

    def _get(self, row, key: int | None) -> list[list[int]]:
        fs, path = file_system(f"{self.path}/{row['name']}.idx")
        a, b = np.array([key or 0], np.int64).view(np.uint64), np.array([key is None], np.uint64)
        with fs.open_input_file(path) as file:
            docs, distinct, at, table = self._hash(row["name"], file)
            slot = int(table.slots(a, b)[0])
            if slot < 0 or self._at(file, "<u4", at + 4 * slot)[0] != fingerprint(a, b)[0]:
                return []
            first, count = (int(self._at(file, "<u4", at + 4 * (distinct * i + slot))[0]) for i in (1, 2))
            offsets = self._at(file, "<u8", at + 12 * distinct + 8 * docs + -(-docs // 8) + 8 * first, count + 1).tolist()
        fs, path = file_system(f"{self.path}/{row['name']}.ids")
        with fs.open_input_file(path) as file:
            return [self._at(file, f"<u{row['width']}", i * row["width"], j - i).tolist() for i, j in zip(offsets, offsets[1:])]

    def get(self, key: int | None) -> list[list[int]]:
        """The ids of each document with this key, in file order; a document of one key may go on in the next file."""
        out, at = [], 0
        rows = self.with_null if key is None else self.files[bisect_left(self.ends, key) :]
        while at < len(rows) and (key is None or rows[at]["min_key"] <= key):
            out += self._get(rows[at], key)
            at += 1
        return out


def token_shards(df: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write ``df`` as token shards (under ``path``, else in the shared folder) and return what reading them back gives."""
    path = path or fresh_path(df.sparkSession, "tokens")
    write_shards(df, path, tokenizer, end_id, key, text)
    return read_documents(df.sparkSession, path).withColumnRenamed("key", key)
