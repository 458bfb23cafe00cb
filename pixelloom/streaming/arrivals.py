"""Files that arrive over time: an incremental listing with checksums, and running colour counts of pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_FILES = "path string, modificationTime timestamp, length long, content binary"


def listing(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, modified, length, sha256): each file once, when it is first seen."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))


def append_listing(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Adds what has arrived since the last run to a Parquet table, exactly once, and ends."""
    return listing(spark, folder, files_per_batch).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def color_counts(pixels: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Pixels and mean luminance of each image and hour of arrival, from a stream (image_id, arrived, r, g, b); rows later than
    `late` are left out of an hour that has been closed."""
    light = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722
    return pixels.withWatermark("arrived", late).groupBy(F.window("arrived", window), "image_id").agg(F.count("*").alias("pixels"), F.avg(light).alias("luminance"))
