"""What the text operators share: scratch tables in the cluster's shared folder
and small Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tessella

#: Rows of a whole-text table in one Arrow batch; the default of 10,000 holds
#: too much memory where texts are long.
TEXT_BATCH_ROWS = 2_000

#: Rows of a table of a few numbers that may be broadcast: about 24 MB.
MAX_BROADCAST_ROWS = 1_000_000

#: The characters that end a word: the ASCII white space of Python's
#: ``bytes.split`` and of the pattern ``[\x20\x09-\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session that
    names none gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(os.getcwd(), "spark-warehouse", "scratch")
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root}/tessella/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that each application has written, in order.
_made: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, compressed by ``codec`` or as the session has it, and read it back.

    It cuts the lineage, survives the loss of executors, and hides the
    partitioning, so that later joins shuffle both sides and adaptive execution
    may split a hot key.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=codec)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` (written, a few numbers a row) marked for broadcast if it has at most ``most`` rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessella/" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_mark(spark: SparkSession) -> int:
    """A mark for ``clear_since``."""
    return len(_made.get(spark.sparkContext.applicationId, ()))


def clear_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the tables that ``materialize`` has made since ``mark``, but for those that ``keep`` reads.  No other result of that time may still be needed."""
    made = _made.get(spark.sparkContext.applicationId, [])
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    for path in made[mark:]:
        if path.rsplit("/", 1)[-1] not in kept:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            made.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder; results that are not yet written elsewhere go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make Python workers ready for what follows: send them this package, and keep Arrow batches of whole texts small.

    The size of batches is the session's from then on: results are lazy, so it has to hold until the caller has run them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(tessella.__file__).parent
        folder = tempfile.mkdtemp()  # on the driver alone, which serves the archive as long as it runs
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / "tessella.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


#: What operators keep in a Python worker from task to task.
worker_caches: list[dict] = []


def forget() -> None:
    """Give back what other operators keep in this Python worker, to the system where it can take it."""
    for cache in worker_caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: Column | str) -> Column:
    """The bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def binary_views(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary Arrow array without nulls, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] else memoryview(b"")
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(data[a:b])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def write_file(uri: str, *parts: bytes) -> None:
    """Write a file whole or not at all; a second attempt replaces the first."""
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(tmp, path)


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads the bits of its input."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of whole rows, of columns of any type."""
    plain = lambda kind: not any(x in kind.simpleString() for x in ("map<", "variant"))
    return F.xxhash64(*(c if plain(f.dataType) else F.to_json(F.struct(c)) for c, f in zip(own_columns(df), df.schema.fields)))
