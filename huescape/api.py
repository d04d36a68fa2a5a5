"""From image files to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.names import Names
from .plans.palette import Palette
from .sources.images import read_images
from .store import scope, tidy


def run_pipeline(spark: SparkSession, path: str | list[str], downscale: bool = True, names: Names | None = None) -> Palette:
    """The relations of any number of image files. release() deletes what they have written."""
    pixels, paths = read_images(spark, path, downscale)
    return Palette(pixels, names, keep=True, paths=paths)


@tidy
def reports(spark: SparkSession, path: str | list[str], downscale: bool = True, names: Names | None = None) -> DataFrame:
    """image_id, path, report, html: a row for each image."""
    p = run_pipeline(spark, path, downscale, names).prepare("html")
    return p.paths.join(p.prose, "image_id").join(p.html, "image_id")


def analyze_image(spark: SparkSession, path: str, downscale: bool = True, names: Names | None = None) -> tuple[str, str]:
    """The report of one image as text and as HTML."""
    with scope():
        row = reports(spark, path, downscale, names).first()
    if row is None:
        raise ValueError(f"not an image that can be read: {path}")
    return row["report"], row["html"]
