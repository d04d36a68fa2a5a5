"""Image files as a relation of pixels.

Headers are read first, so that an image that is too large is refused before anything is decoded. Decoding is Spark's
`image` source; its rows of bytes become pixels by NumPy, scaled down on the way if asked for."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_PIXELS, MAX_SIDE, WORK_SIDE

_HEADER = "path string, kind string, width long, height long"
_PIXELS = "image_id long, y long, x long, r long, g long, b long"


def header(data: bytes | memoryview) -> tuple[str, int, int] | None:
    """Format, width and height from the beginning of a PNG, GIF, BMP or JPEG file; None if it is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", abs(w), abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 if kind in (0x01, 0xFF, *range(0xD0, 0xD9)) else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # No copy: a file's markers are followed wherever they are, whatever lies between them.
        found = [header(memoryview(x.as_buffer() or b"").cast("B")) or (None, None, None) for x in batch.column("content")]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], ["path", "kind", "width", "height"])


def inspect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, kind, width, height of image files, by their headers alone; nulls for files that aren't images. (Spark reads
    whole files, one after the other; nothing is decoded.)"""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no such image: {path}") from None
        raise
    return files.select("path", "content").mapInArrow(_headers, _HEADER)


def checked(spark: SparkSession, path: str | list[str], downscale: bool = True) -> DataFrame:
    """path, reason: why a file can't be used (null: it can)."""
    w, h = F.col("width"), F.col("height")
    longest, size = F.greatest(w, h), F.format_string("%d x %d pixels", w, h)
    gone = F.lit(downscale) & (longest > WORK_SIDE) & (F.floor(F.least(w, h) * (F.lit(float(WORK_SIDE)) / longest)) < 1)
    reason = F.when(F.col("kind").isNull(), "not an image that can be read").when(too_large(w, h), F.concat(F.lit("too large: "), size)).when(gone, F.concat(F.lit("too thin to scale down: "), size))
    return inspect(spark, path).select("path", reason.alias("reason"))


def too_large(width, height):
    return (F.greatest(width, height) > MAX_SIDE) | (width * height > MAX_PIXELS)


def scaled(width: int, height: int, most: int = WORK_SIDE) -> tuple[int, int]:
    """The size after scaling the longest edge down to `most`; both edges are cut off to whole pixels."""
    longest = max(width, height)
    if longest <= most:
        return width, height
    return int(width * (most / longest)), int(height * (most / longest))


def _taps(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanczos (three lobes, widened by the scale): for each new pixel the places it is made from and their weights."""
    scale = size / new
    wide, centre = max(scale, 1.0), (np.arange(new) + 0.5) * scale
    low, high = np.maximum(0, (centre - 3 * wide + 0.5).astype(int)), np.minimum(size, (centre + 3 * wide + 0.5).astype(int))
    at = low[:, None] + np.arange((high - low).max())[None, :]
    t = (at - centre[:, None] + 0.5) / wide
    w = np.where((at < high[:, None]) & (np.abs(t) < 3), np.sinc(t) * np.sinc(t / 3), 0.0)
    return np.minimum(at, size - 1), w / w.sum(axis=1, keepdims=True)


def _scale_rows(plane: np.ndarray, new: int) -> np.ndarray:
    """A plane's rows scaled to `new` rows, rounded to bytes: a new row at a time, from the few that it needs."""
    out = np.empty((new, plane.shape[1]), np.uint8)
    for k, (at, w) in enumerate(zip(*_taps(plane.shape[0], new), strict=True)):
        out[k] = np.clip(np.floor(w @ plane[at] + 0.5), 0, 255)
    return out


def downscale(rgb: np.ndarray, most: int = WORK_SIDE) -> np.ndarray:
    """An image of (height, width, 3) bytes, or sums of bytes, scaled by Lanczos, along rows first, rounded to bytes after each direction.
    Beyond the image itself this needs a channel of one direction's result and some rows as doubles."""
    h, w = rgb.shape[:2]
    nw, nh = scaled(w, h, most)
    if (nw, nh) == (w, h):
        return np.minimum(rgb, 255)
    if not nw or not nh:
        raise ValueError(f"an image of {w} x {h} pixels has no pixels left at {nw} x {nh}")
    return np.stack([_scale_rows(_scale_rows(rgb[:, :, c].T, nw).T, nh) for c in range(3)], axis=2)


def _emit(image_id: int, rgb: np.ndarray, seen: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """An image's pixels, or those of them that are seen."""
    rows = max(1, (1 << 18) // rgb.shape[1])
    for y in range(0, rgb.shape[0], rows):
        part = rgb[y : y + rows]
        ys, xs = np.divmod(np.arange(part.shape[0] * part.shape[1]) if seen is None else np.flatnonzero(seen[y : y + rows]), part.shape[1])
        values = [np.full(len(ys), image_id), ys + y, xs, *(part[ys, xs, c].astype(np.int64) for c in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], [c.split()[0] for c in _PIXELS.split(", ")])


def _rgb(raw: np.ndarray) -> np.ndarray:
    return np.repeat(raw, 3, axis=2) if raw.shape[2] == 1 else raw[:, :, 2::-1]


def _decode(small: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None  # to be scaled once all of its layers are there
        for batch in batches:
            for image_id, h, w, n, data, layer in zip(*(batch.column(c) for c in ("image_id", "height", "width", "n", "data", "layer")), strict=True):
                raw, top = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), n.as_py()), layer.as_py()
                if not small:
                    yield from _emit(image_id.as_py(), _rgb(raw), raw[:, :, 3] > 0 if top else None)
                elif top:
                    whole = whole + _rgb(raw) * (raw[:, :, 3:] > 0).astype(np.int32)
                else:
                    if now is not None:
                        yield from _emit(now, downscale(whole), None)
                    now, whole = image_id.as_py(), _rgb(raw)
        if now is not None:
            yield from _emit(now, downscale(whole), None)

    return run


def read_images(spark: SparkSession, path: str | list[str], downscale: bool = True, layers: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, paths) of image files: image_id, y, x, r, g, b, and image_id, path. image_id is a hash of the path.

    layers: path of further layers, RGBA files named as the images they belong to and as large; their opaque pixels are
    further pixels of these images. An image to be scaled is the sum of its layers, cut off at 255 after scaling.

    FileNotFoundError if nothing is there; ValueError, before any decoding, if a file is not an image or too large (over
    10,000 pixels along a side, or 50 million), or if it is so thin that scaling would leave nothing of it."""
    bad = checked(spark, path, downscale).where("reason is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['reason']}: {bad[0]['path']}")
    image = spark.read.format("image").load(path).select("image.*").where("height > 0")
    paths = image.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"))
    columns = ("height", "width", F.col("nChannels").alias("n"), "data")
    rows = image.select(F.xxhash64("origin").alias("image_id"), *columns, F.lit(0).alias("layer"))
    if layers:
        name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
        more = spark.read.format("image").load(layers).select("image.*").withColumn("name", F.regexp_extract("origin", "[^/]+$", 0))
        rows = rows.unionByName(more.join(paths.select("image_id", name), "name").select("image_id", *columns, F.lit(1).alias("layer")))
        if downscale:
            rows = rows.repartition("image_id").sortWithinPartitions("image_id", "layer")
    return rows.mapInArrow(_decode(downscale), _PIXELS), paths
