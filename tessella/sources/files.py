"""Files around the tables: arrays, images' places, checksums, and what is finished."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The endings that a tile's image may have, in order, and that of a mask.
ENDINGS = ("", ".jpg", ".jpeg", ".png")
MASK_ENDING = ".grandqc.png"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (path, name, size) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def npy_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows (patch_id, features) of a folder of ``.npy`` files with a vector each; the file's name is the tile."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for part in parts:
            vectors = [np.load(io.BytesIO(c), allow_pickle=False).astype("float32").ravel() for c in part["content"]]
            if not all(np.isfinite(v).all() for v in vectors):
                raise ValueError("features have to be finite")
            yield pd.DataFrame({"patch_id": part["path"].str.extract(r"([^/]+)\.npy$")[0], "features": vectors})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(read, "patch_id string, features array<float>")


def resolve_images(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """``tiles`` (slide_id, patch_id) with ``path``: as named, or with the first ending that is there; null if none is."""
    wanted = tiles.select("*", F.posexplode(F.array(*(F.concat("slide_id", F.lit("/"), "patch_id", F.lit(e)) for e in ENDINGS))).alias("try", "tail"))
    there = files.select(F.col("path").alias("found"), F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("tail"))
    hits = wanted.join(there, "tail").groupBy("slide_id", "patch_id").agg(F.min_by("found", "try").alias("path"))
    return tiles.join(hits, ["slide_id", "patch_id"], "left")


def resolve_masks(slides: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """``slides`` with ``mask``: the file of the slide in the first of ``folders`` that has one."""
    order = F.array(*map(F.lit, dict.fromkeys(f.rstrip("/") for f in folders)))
    held = files.withColumn("folder", F.regexp_replace("path", "^file:/+|/[^/]*$", "")).withColumn("folder", F.concat(F.lit("/"), F.ltrim("folder")))
    held = held.withColumn("place", F.array_position(order, F.regexp_replace("folder", "^/+", "/"))).where("place > 0")
    hits = held.select(F.regexp_replace("name", MASK_ENDING.replace(".", r"\.") + "$", "").alias("slide_id"), "place", "path").groupBy("slide_id").agg(F.min_by("path", "place").alias("mask"))
    return slides.join(hits, "slide_id", "left")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def unfinished(questions: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Questions without a result."""
    return questions.join(done.select(*on).distinct(), on, "left_anti")
