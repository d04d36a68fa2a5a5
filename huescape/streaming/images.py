"""Palettes of images as they arrive in a folder. Each image is analysed by itself, so no state and no watermark is
needed: every micro-batch goes through the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import reports
from ..sources.images import checked
from ..store import scope, stored

FILES = 100


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, downscale: bool = True, files: int = FILES, **trigger) -> StreamingQuery:
    """Appends image_id, path, report, html of each new image of folder to Parquet files in out/reports, and path, reason
    of each file that can't be read to out/rejects. A micro-batch is worked off in slices of about `files` images, whatever
    the trigger puts into it; paths alone are what the driver sees. A batch that is run again after a failure replaces its
    own folders, so each file is reported once. trigger: as of writeStream.trigger, e.g. availableNow=True."""
    arriving = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").toLocalIterator()]
        for k in range(0, len(paths), files):
            some, place = paths[k : k + files], f"batch={number}/slice={k // files}"
            with scope():
                seen = stored(checked(batch.sparkSession, some, downscale), "arrived")
                seen.where("reason is not null").select("path", "reason").write.mode("overwrite").parquet(f"{out}/rejects/{place}")
                good = [r["path"] for r in seen.where("reason is null").select("path").collect()]
                if good:
                    reports(batch.sparkSession, good, downscale).write.mode("overwrite").parquet(f"{out}/reports/{place}")

    return arriving.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
