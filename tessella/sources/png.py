"""Masks from PNG files: every file is decoded in the task that reads it, into the rows of a summed-area table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import mask_window
from tessella.shipping import ship
from tessella.sources.files import MASK_ENDING

# The signature of the format, channels by colour type, the passes of an interlaced image, and the weights of red, green and blue in grey.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
GREY = (19595, 38470, 7471)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            raise ValueError("a PNG file is cut off")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _row(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes as it was before its filter; ``step`` bytes are a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        out = np.zeros(-(-len(row) // step) * step, np.uint8)
        out[: len(row)] = row
        return np.cumsum(out.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError(f"unknown row filter {kind}")
    out, up = row.tolist(), above.tolist()
    for i in range(len(out)):
        left, top = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            guess = (left + top) // 2
        else:
            corner = up[i - step] if i >= step else 0
            a, b, c = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
            guess = left if a <= b and a <= c else top if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def _pass(data: np.ndarray, at: int, width: int, height: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """The samples of an image, or of one pass of it, and the place after its bytes."""
    size, step = -(-width * bits * channels // 8), max(1, bits * channels // 8)
    if at + height * (size + 1) > len(data):
        raise ValueError("a PNG image is cut off")
    rows, above = np.zeros((height, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(height):
        start = at + y * (size + 1)
        rows[y] = above = _row(int(data[start]), data[start + 1 : start + 1 + size], above, step)
    if bits == 16:
        samples = rows.view(">u2").astype(np.int64)
    elif bits == 8:
        samples = rows.astype(np.int64)
    else:
        split = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        samples = (split << np.arange(bits - 1, -1, -1)).sum(axis=2, dtype=np.int64)
    return samples[:, : width * channels].reshape(height, width, channels), at + height * (size + 1)


def decode(data: bytes) -> np.ndarray:
    """The image of a PNG file as grey values from 0 to 255, without its transparency."""
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed or not head[0] or not head[1]:
        raise ValueError("a PNG file without an image")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in CHANNELS or bits not in (1, 2, 4, 8, 16):
        raise ValueError(f"no PNG colour type {colour} of {bits} bits")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    image, at = np.zeros((height, width, CHANNELS[colour]), np.int64), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            image[y::dy, x::dx], at = _pass(raw, at, w, h, bits, CHANNELS[colour])
    if colour == 3:
        if palette is None or image.max() >= len(palette):
            raise ValueError("a PNG file without the colours that it uses")
        image = palette[image[:, :, 0]]
    elif bits == 16:
        image = image >> 8
    elif bits < 8:
        image = image * (255 // ((1 << bits) - 1))
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.uint8)
    return ((image[:, :, :3] @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


def mask_sums(images: DataFrame) -> DataFrame:
    """Rows (slide_id, width, height, row, sums) of the masks in ``images`` (slide_id, content): ``sums[i]`` counts the set pixels left of column i in the rows above ``row``.

    A pixel is set if it is not black.  Rows go from 0 to the height, and sums from
    0 to the width.  What is no whole PNG image is an error.
    """
    ship(images.sparkSession)
    schema = "slide_id string, width int, height int, row int, sums array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                mask = decode(content.as_py()) > 0
                height, width = mask.shape
                sums = np.zeros((height + 1, width + 1), np.int32)
                sums[1:, 1:] = np.cumsum(np.cumsum(mask, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
                for first in range(0, height + 1, 512):
                    part = sums[first : first + 512]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width + 1, dtype=np.int32)), pa.array(part.ravel()))
                    n = len(part)
                    columns = [pa.array([slide] * n), *(pa.array(np.full(n, v, np.int32)) for v in (width, height)), pa.array(np.arange(first, first + n, dtype=np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["slide_id", "width", "height", "row", "sums"])

    return images.select(F.col("slide_id").cast("string").alias("slide_id"), "content").mapInArrow(read, schema)


def masks(spark: SparkSession, path: str, ending: str = MASK_ENDING) -> DataFrame:
    """``mask_sums`` of the files ``<slide><ending>`` of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path)
    slide = F.regexp_replace(F.element_at(F.split("path", "/"), -1), ending.replace(".", r"\.") + "$", "")
    return mask_sums(files.select(slide.alias("slide_id"), "content"))


def covered(regions: DataFrame, sums: DataFrame, slides: DataFrame) -> DataFrame:
    """``regions`` (slide_id, x, y, w, h and others) with ``fraction``: the part of each that its slide's mask covers, as ``regions.mask_fraction`` has it.

    ``slides`` has slide_id, slide_width and slide_height.  Two rows of the sums
    are looked up for a region; one without a mask has a null fraction.
    """
    sizes = sums.where("row = 0").select("slide_id", "width", "height").join(slides, "slide_id")
    out = regions.join(sizes, "slide_id", "left")
    left, right, across = mask_window(F.col("x"), F.col("w"), F.col("slide_width"), F.col("width"))
    top, bottom, down = mask_window(F.col("y"), F.col("h"), F.col("slide_height"), F.col("height"))
    out = out.withColumns({"l_": left, "r_": right, "t_": top, "b_": bottom, "area_": across * down})
    for name, row in (("high_", "t_"), ("low_", "b_")):
        held = sums.select("slide_id", F.col("row").alias(row), F.col("sums").alias(name))
        out = out.join(held, ["slide_id", row], "left")
    at = lambda sums, column: F.coalesce(F.get(sums, F.col(column).cast("int")), F.lit(0))
    total = at("low_", "r_") - at("low_", "l_") - at("high_", "r_") + at("high_", "l_")
    out = out.withColumn("fraction", F.when(F.col("width").isNotNull(), total / F.col("area_")))
    return out.drop("l_", "r_", "t_", "b_", "area_", "high_", "low_", "width", "height", "slide_width", "slide_height")
