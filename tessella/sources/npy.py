"""A data source of NumPy feature files: ``spark.read.format("npy_features").load(folder)``.

A folder has a folder for each slide, with a ``.npy`` file of one vector for each
tile.  Files are packed into partitions by their sizes, equality filters on the
slide choose the folders that are listed at all, and the vectors are only read if
they are asked for.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessella.shipping import ship

NAME, SCHEMA = "npy_features", "slide_id string, patch_id string, features array<float>"
#: Bytes of files in a partition.
PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Files (slide, tile, path) of one partition."""

    files: list[tuple[str, str, str]]


def _file_system(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1) if path.startswith("file:") else path)


class Reader(DataSourceReader):
    def __init__(self, path: str, with_features: bool, partition_bytes: int):
        self.path, self.with_features, self.partition_bytes, self.slides = path, with_features, partition_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Slides that are named choose folders; other filters are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("slide_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.slides = named if self.slides is None else self.slides & named
            else:
                yield f

    def partitions(self) -> list[Files]:
        import pyarrow.fs as pafs

        fs, root = _file_system(self.path)
        folders = [f"{root}/{s}" for s in sorted(self.slides)] if self.slides is not None else [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory]
        out, held, size = [], [], 0
        for folder in sorted(folders):
            for info in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
                if info.path.endswith(".npy"):
                    held.append((folder.rsplit("/", 1)[-1], info.base_name[: -len(".npy")], info.path))
                    size += info.size
                    if size >= self.partition_bytes:
                        out, held, size = [*out, Files(held)], [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        import numpy as np

        fs, _ = _file_system(self.path)
        for slide, tile, path in partition.files:
            if not self.with_features:
                yield slide, tile
                continue
            with fs.open_input_file(path) as f:
                vector = np.load(io.BytesIO(f.read()), allow_pickle=False).astype("float32").ravel()
            if not np.isfinite(vector).all():
                raise ValueError(f"features have to be finite: {path}")
            yield slide, tile, vector.tolist()


class NpyFeatures(DataSource):
    """Options: ``path``; ``features`` (false leaves the vectors unread and without a column); ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _with_features(self) -> bool:
        return str(self.options.get("features", "true")).lower() != "false"

    def schema(self) -> str:
        return SCHEMA if self._with_features() else SCHEMA.rsplit(", ", 1)[0]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._with_features(), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyFeatures)
