"""Pixel relations made from the tables of the test data: two kinds of images with known properties; and files of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 x 30 images from orders: horizontal ramps, vertical ramps, blocks with scattered accents."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    p = o.selectExpr("k div 1500 AS image_id", "(k % 1500) div 50 AS y", "k % 50 AS x", "o_orderstatus AS s")
    return p.selectExpr(
        "image_id", "y", "x",
        "CAST(CASE image_id % 3 WHEN 0 THEN x * 255 div 49 WHEN 1 THEN y * 255 div 29 ELSE IF(x < 25, 200, 30) END AS BIGINT) AS r",
        "CAST(CASE image_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 255 - y * 255 div 29 ELSE IF(y < 15, 40, 180) END AS BIGINT) AS g",
        "CAST(CASE image_id % 3 WHEN 0 THEN 255 - x * 255 div 49 WHEN 1 THEN 128 ELSE IF(s = 'P', 255, 60) END AS BIGINT) AS b",
    )


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 x 25 images from events: many bins and no gradient."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id", "event_type")
    return e.selectExpr(
        "1000 + event_id div 1000 AS image_id", "(event_id % 1000) div 40 AS y", "event_id % 40 AS x",
        "CAST(floor(value) % 256 AS BIGINT) AS r", "user_id * 37 % 256 AS g", "CAST(length(event_type) * 23 % 256 AS BIGINT) AS b",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b of both kinds."""
    return ramp(spark, sf_dir).unionByName(noise(spark, sf_dir))


def widened(df: DataFrame, times: int = 7) -> DataFrame:
    """Images with `times` columns for each one, all of them different: wide enough to be scaled down."""
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("x", F.col("x") * times + F.col("i"))
    return df.select("image_id", "y", "x", *(((F.col(c) + F.col("i") * step) % 256).cast("long").alias(c) for c, step in (("r", 30), ("g", 11), ("b", 50))))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_head(width: int, height: int, channels: int = 3) -> bytes:
    """What an RGB or (of four channels) RGBA file of this size begins with."""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0))


class _Png:
    """One file, written as its pixels come. It gets its name when it is whole, so an attempt that fails leaves no image.
    A file of four channels may leave out pixels, which are clear; all others are opaque."""

    def __init__(self, fs, path: str, width: int, height: int, channels: int):
        self.fs, self.path, self.width, self.total, self.at, self.channels = fs, path, width, width * height, 0, channels
        self.out, self.pack = fs.open_output_stream(f"{path}.part", compression=None), zlib.compressobj()
        self.out.write(png_head(width, height, channels))

    def add(self, place: np.ndarray, rgb: np.ndarray) -> None:
        """Pixels in order of their places: rows one after the other, all of them different."""
        if self.channels == 3:
            if (place != np.arange(len(place)) + self.at).any():
                raise ValueError(f"{self.path}: an image with pixels missing")
            return self._rows(rgb)
        while len(place):
            self._clear(int(place[0]))
            k = int(np.searchsorted(place, self.at + _SPAN))
            rgba = np.zeros((int(place[k - 1]) + 1 - self.at, 4), np.uint8)
            rgba[place[:k] - self.at] = np.insert(rgb[:k], 3, 255, axis=1)
            self._rows(rgba)
            place, rgb = place[k:], rgb[k:]

    def _clear(self, end: int) -> None:
        while self.at < end:
            self._rows(np.zeros((min(_SPAN, end - self.at), 4), np.uint8))

    def _rows(self, values: np.ndarray) -> None:
        starts = np.flatnonzero((np.arange(len(values)) + self.at) % self.width == 0)
        self._write(self.pack.compress(np.insert(values.astype(np.uint8).ravel(), starts * self.channels, 0).tobytes()))
        self.at += len(values)

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(_chunk(b"IDAT", data))

    def close(self) -> None:
        if self.channels == 4:
            self._clear(self.total)
        if self.at != self.total:
            raise ValueError(f"{self.path}: an image with pixels missing")
        self._write(self.pack.flush())
        self.out.write(_chunk(b"IEND", b""))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)


#: Pixels of a layer that are made at once.
_SPAN = 1 << 18


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done = lambda key: pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key], ["image_id", "layer"])
        now, out = None, None
        for batch in batches:
            ids, layers, y, x, w, h, *rgb = (batch.column(c).to_numpy() for c in ("image_id", "layer", "y", "x", "width", "height", "r", "g", "b"))
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(layers) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                if (ids[lo], layers[lo]) != now:
                    if out:
                        out.close()
                        yield done(now)
                    now, top = (int(ids[lo]), int(layers[lo])), int(layers[lo]) > 0
                    if top:
                        fs.create_dir(f"{root}{MORE}/{now[1]}", recursive=True)
                    path = f"{root}{MORE}/{now[1]}/{now[0]}.png" if top else f"{root}/{now[0]}.png"
                    out = _Png(fs, path, int(w[lo]), int(h[lo]), 4 if top else 3)
                out.add((y * w + x)[lo:hi], np.stack([c[lo:hi] for c in rgb], axis=1))
        if out:
            out.close()
            yield done(now)

    return run


#: What is added to a folder's name for that of its images' further layers: a folder for each, files of the same names.
MORE = "-more"


def write_images(df: DataFrame, folder: str) -> int:
    """Each image of a relation of pixels as <image_id>.png in a folder that all executors share, a stream of rows at a
    time; the number of images. Of several pixels at one place (images that share an id), ordered by colour, the n-th goes
    to the n-th layer; the first layer must be whole."""
    size = df.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"))
    rows = df.join(size, "image_id").select("image_id", "y", "x", "width", "height", "r", "g", "b").repartition("image_id")
    nth = F.row_number().over(Window.partitionBy("image_id", "y", "x").orderBy("r", "g", "b")) - 1
    rows = rows.withColumn("layer", nth.cast("long")).sortWithinPartitions("image_id", "layer", "y", "x")
    return rows.mapInArrow(_writer(folder), "image_id long, layer long").where("layer = 0").count()


def further(folder: str) -> str | None:
    """Path of the further layers of a folder's images; None if there are none."""
    from pyarrow.fs import FileSystem, FileType

    fs, root = FileSystem.from_uri(f"{folder}{MORE}")
    return None if fs.get_file_info(root).type == FileType.NotFound else f"{folder}{MORE}/*/*.png"


def _odd_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for i, w, h in zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "height")), strict=True):
                for name, data in ((f"{i}.png", png_head(w, h)), (f"{i}.txt", b"no image")):
                    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                        out.write(data)
            yield batch.select(["image_id"])

    return run


def write_odd(df: DataFrame, folder: str) -> int:
    """For each image the head of a file that claims a great size (every fifth: a great width alone), and a text."""
    i = F.col("image_id")
    ids = df.select("image_id").distinct().select(i, (9000 + i * 531 % 2000).alias("width"), F.when(i % 5 == 0, F.lit(10)).otherwise(4000 + i * 977 % 4000).cast("long").alias("height"))
    return ids.mapInArrow(_odd_writer(folder), "image_id long").count()
