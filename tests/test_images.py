"""Masks from PNG files, regions of rasters, feature files."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import rasters
from tessella.sources import npy, png


def encode(samples, bits, colour, palette=None, interlaced=False, seed=0):
    """A PNG file of samples (height, width, channels), with every filter in turn."""
    height, width, channels = samples.shape
    rng = np.random.default_rng(seed)

    def rows(part):
        h, w = part.shape[:2]
        flat = part.reshape(h, w * channels)
        if bits == 16:
            packed = flat.astype(">u2").view(np.uint8).reshape(h, -1)
        elif bits == 8:
            packed = flat.astype(np.uint8)
        else:
            held = ((flat[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(h, -1).astype(np.uint8)
            packed = np.packbits(held, axis=1)
        step, above, out = max(1, bits * channels // 8), np.zeros(packed.shape[1], int), b""
        for y in range(h):
            row, kind = packed[y].astype(int), int(rng.integers(5))
            left = np.concatenate([np.zeros(step, int), row])[: len(row)]
            corner = np.concatenate([np.zeros(step, int), above])[: len(row)]
            guess = left + above - corner
            a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
            best = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
            coded = (row - (np.zeros(len(row), int), left, above, (left + above) // 2, best)[kind]) & 255
            out, above = out + bytes([kind]) + coded.astype(np.uint8).tobytes(), row
        return out

    parts = [samples[y::dy, x::dx] for x, y, dx, dy in png.PASSES] if interlaced else [samples]
    data = zlib.compress(b"".join(rows(p) for p in parts if p.size))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    out = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, int(interlaced)))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, bits", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png(colour, bits, interlaced):
    rng = np.random.default_rng(bits + colour)
    for height, width in ((1, 1), (5, 13), (23, 9)):
        channels = png.CHANNELS[colour]
        palette = rng.integers(0, 256, (1 << bits, 3)) if colour == 3 else None
        samples = rng.integers(0, 1 << bits, (height, width, channels))
        grey = palette[samples[:, :, 0]] if colour == 3 else samples >> 8 if bits == 16 else samples * (255 // ((1 << bits) - 1))
        want = grey[:, :, 0] if grey.shape[2] < 3 else (19595 * grey[:, :, 0] + 38470 * grey[:, :, 1] + 7471 * grey[:, :, 2] + 32768) >> 16
        assert (png.decode(encode(samples, bits, colour, palette, interlaced)) == want).all()


def test_broken_png():
    good = encode(np.ones((4, 4, 1), int), 8, 0)
    for bad in (b"", b"GIF89a", good[:30], good[:-20], png.SIGNATURE + good[8:33], good.replace(struct.pack(">II", 4, 4), struct.pack(">II", 4, 9))):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)


def test_masks_cover_regions(spark, tmp_path):
    rng = np.random.default_rng(4)
    held = {}
    for slide, (height, width) in {"a": (40, 30), "b": (1, 7), "c": (600, 20)}.items():
        held[slide] = rng.integers(0, 2, (height, width))
        (tmp_path / f"{slide}.grandqc.png").write_bytes(encode(held[slide][:, :, None], 1, 0))
    slides = spark.createDataFrame([("a", 3000, 4000), ("b", 700, 100), ("c", 200, 6000), ("none", 10, 10)], "slide_id string, slide_width long, slide_height long")
    rows = [(s, int(x), int(y), int(w), int(h)) for s in ("a", "b", "c") for x, y, w, h in zip(*(rng.integers(*r, 30) for r in ((-50, 3000), (-50, 6000), (1, 900), (1, 900))))]
    regions = spark.createDataFrame([*rows, ("none", 0, 0, 5, 5)], "slide_id string, x long, y long, w long, h long")
    size = {"a": (3000, 4000), "b": (700, 100), "c": (200, 6000)}
    got = png.covered(regions, png.masks(spark, str(tmp_path)), slides).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["slide_id"] == "none":
            assert r["fraction"] is None
            continue
        mask, (w, h) = held[r["slide_id"]], size[r["slide_id"]]
        l, t = int(np.floor(r["x"] / w * mask.shape[1])), int(np.floor(r["y"] / h * mask.shape[0]))
        right, bottom = int(np.ceil((r["x"] + r["w"]) / w * mask.shape[1])), int(np.ceil((r["y"] + r["h"]) / h * mask.shape[0]))
        total = mask[max(0, t) : max(0, bottom), max(0, l) : max(0, right)].sum()
        assert r["fraction"] == pytest.approx(total / (max(1, right - l) * max(1, bottom - t)))
    (tmp_path / "z.grandqc.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a PNG"):
        png.masks(spark, str(tmp_path)).collect()


def direct(image, level_width, level_height, left, top, width, height, output):
    """A crop that may reach over the edges, on white, resampled by sums over all pixels."""
    crop = np.full((height, width, 3), 255.0)
    for y in range(height):
        for x in range(width):
            if 0 <= left + x < level_width and 0 <= top + y < level_height:
                *colour, alpha = image[top + y, left + x].astype(float)
                crop[y, x] = np.floor(np.array(colour) * (alpha / 255.0) + 255.0 * (1 - alpha / 255.0) + 0.5)

    def along(rows, size):
        scale, out = size / output, []
        for i in range(output):
            centre, wide = (i + 0.5) * scale, max(1.0, scale)
            first, end = max(0, int(centre - 2 * wide + 0.5)), min(size, int(centre + 2 * wide + 0.5))
            each = []
            for k in range(first, end):
                d = abs((k + 0.5 - centre) / wide)
                each.append(1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0)
            value = sum(rows[k] * w for k, w in zip(range(first, end), each)) / sum(each)
            out.append(np.clip(np.floor(np.round(value, 6) + 0.5), 0, 255))
        return np.array(out)

    return along(along(crop.transpose(1, 0, 2), width).transpose(1, 0, 2), height)


def test_regions_of_rasters(spark):
    """Across the edges of blocks and of slides, at both levels, larger and smaller than the output."""
    rng = np.random.default_rng(9)
    block, output = 16, 12
    sizes = {"s": (70, 50), "t": (33, 20)}
    images, rows = {}, []
    for slide, (w, h) in sizes.items():
        for level, ds in enumerate((1, 2)):
            lw, lh = -(-w // ds), -(-h // ds)
            image = images[slide, level] = rng.integers(0, 256, (lh, lw, 4)).astype(np.uint8)
            for by in range(-(-lh // block)):
                for bx in range(-(-lw // block)):
                    part = np.zeros((block, block, 4), np.uint8)
                    own = image[by * block : (by + 1) * block, bx * block : (bx + 1) * block]
                    part[: own.shape[0], : own.shape[1]] = own
                    rows.append((slide, level, bx, by, bytearray(part.tobytes())))
    blocks = spark.createDataFrame(rows, "slide_id string, level int, bx int, by int, pixels binary")
    slides = spark.createDataFrame([(s, w, h, [1.0, 2.0]) for s, (w, h) in sizes.items()], "slide_id string, slide_width long, slide_height long, downsamples array<double>")
    wanted = [("s", "in", 3, 5, 12, 12), ("s", "small", 10, 14, 7, 5), ("s", "wide", 0, 0, 70, 13), ("s", "edge", 60, 40, 30, 30), ("s", "before", -9, -4, 24, 30), ("t", "all", 0, 0, 33, 20), ("t", "out", 100, 100, 12, 12), ("s", "one", 69, 49, 1, 1)]
    regions = spark.createDataFrame(wanted, "slide_id string, patch_id string, x long, y long, w long, h long")
    got = {r["patch_id"]: r for r in rasters.read_regions(regions, slides, blocks, block, output).collect()}
    assert set(got) == {w[1] for w in wanted}
    for slide, name, x, y, w, h in wanted:
        level = 1 if min(w, h) >= 2 * output else 0
        r, ds, image = got[name], 1 << level, images[slide, level]
        width, height = max(1, -(-w // ds)), max(1, -(-h // ds))
        assert (r["level"], r["read_width"], r["read_height"]) == (level, width, height)
        want = direct(image, image.shape[1], image.shape[0], x // ds, y // ds, width, height, output)
        assert (np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(output, output, 3) == want).all(), name
    assert (np.frombuffer(bytes(got["out"]["pixels"]), np.uint8) == 255).all() and got["before"]["padding"]["left"] == 9
    told = rasters.pixel_rows(spark.createDataFrame([got["in"]]), output, ["slide_id", "patch_id"]).agg(F.count("*"), F.sum("red")).first()
    assert told[0] == output**2 and told[1] == np.frombuffer(bytes(got["in"]["pixels"]), np.uint8)[::3].sum()
    with pytest.raises(Exception, match="no slide"):
        rasters.read_regions(regions.withColumn("slide_id", F.lit("zz")), slides, blocks, block, output).collect()


def test_regions_are_put_together_in_parts(spark, monkeypatch):
    """Many regions of one block go in several parts, with one row for each, also of those that share a name."""
    monkeypatch.setattr(rasters, "MOST_TOGETHER", 40)
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (32, 32, 4)).astype(np.uint8)
    rows = [("s", 0, x, y, bytearray(image[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16].tobytes())) for x in (0, 1) for y in (0, 1)]
    blocks = spark.createDataFrame(rows, "slide_id string, level int, bx int, by int, pixels binary")
    slides = spark.createDataFrame([("s", 32, 32, [1.0])], "slide_id string, slide_width long, slide_height long, downsamples array<double>")
    wanted = [("s", f"p{i // 2}", int(x), int(y), 8, 8) for i, (x, y) in enumerate(rng.integers(-6, 30, (300, 2)))]
    regions = spark.createDataFrame(wanted, "slide_id string, patch_id string, x long, y long, w long, h long")
    read = rasters.read_regions(regions, slides, blocks, 16, 8)
    got = sorted(tuple(r) for r in rasters.channel_sums(read, 8, ["patch_id"]).collect())
    wide = np.pad(image, ((6, 6), (6, 6), (0, 0)))
    assert got == sorted((name, *(int(c) for c in rasters.on_white(wide[y + 6 : y + 14, x + 6 : x + 14]).sum(axis=(0, 1), dtype=int))) for _, name, x, y, _, _ in wanted)


def test_feature_files(spark, tmp_path):
    npy.register(spark)
    for slide in ("s1", "s2", "s3"):
        (tmp_path / slide).mkdir()
        for tile in range(5):
            held = io.BytesIO()
            np.save(held, np.array([tile, len(slide), 0.5], "float64"))
            (tmp_path / slide / f"t{tile}.npy").write_bytes(held.getvalue())
    (tmp_path / "s3" / "t0.npy").write_bytes(b"broken")
    read = lambda **options: spark.read.format("npy_features").options(**options).load(str(tmp_path))
    one = read().where("slide_id = 's2'")
    assert sorted((r["slide_id"], r["patch_id"], list(r["features"])) for r in one.collect()) == [("s2", f"t{i}", [i, 2, 0.5]) for i in range(5)]
    assert {r["slide_id"] for r in read().where("slide_id in ('s1', 's2') and patch_id = 't1'").collect()} == {"s1", "s2"}  # the broken file of s3 is never opened
    assert read(features="false").columns == ["slide_id", "patch_id"] and read(features="false").count() == 15
    assert read(partitionBytes=1).where("slide_id = 's1'").rdd.getNumPartitions() == 5
    assert read().where("slide_id = 'none'").count() == 0
    with pytest.raises(Exception):
        read().collect()
