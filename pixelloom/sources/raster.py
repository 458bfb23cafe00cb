"""Rasters as long pixel tables: (image_id, y, x, value...), from image files or from vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.operators.components import stored

#: Rows of an image built from vectors: so the number of images grows with the table.
ROWS_PER_IMAGE = 64
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp")


def gray_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """(image_id, y, x, v): each vector is a row of 64 grey values, 64 rows an image."""
    value = F.floor((F.col("e").cast("double") + 0.6) * 212.5).cast("int")
    cells = embeddings.select(F.floor(F.col("vec_id") / ROWS_PER_IMAGE).alias("image_id"), (F.col("vec_id") % ROWS_PER_IMAGE).cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return cells.select("image_id", "y", "x", value.alias("v"))


def rgb_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): three neighbouring grey values are one pixel."""
    level = lambda k: F.floor((F.element_at("embedding", 3 * F.col("x") + k).cast("double") + 0.6) * 212.5).cast("int")
    cells = embeddings.select("embedding", F.floor(F.col("vec_id") / ROWS_PER_IMAGE).alias("image_id"), (F.col("vec_id") % ROWS_PER_IMAGE).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    return cells.select("image_id", "y", "x", level(1).alias("r"), level(2).alias("g"), level(3).alias("b"))


def _orientation(head: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 if there is none."""
    at = head.find(b"Exif\x00\x00")
    if at < 0:
        return 1
    tiff = head[at + 6 :]
    order = "little" if tiff[:2] == b"II" else "big"
    number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
    first = number(4, 4)
    for k in range(number(first, 2)):
        entry = first + 2 + 12 * k
        if number(entry, 2) == 0x0112:
            return number(entry + 8, 2) or 1
    return 1


def upright(raster: np.ndarray, orientation: int) -> np.ndarray:
    """A raster turned and mirrored as its orientation says."""
    if orientation in (2, 4, 5, 7):
        raster = raster[:, ::-1] if orientation in (2, 5, 7) else raster[::-1]
    turns = {3: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.rot90(raster, turns)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image, height, width, channels, data, head in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            raster = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            raster = np.repeat(raster, 3, 2) if channels == 1 else raster[:, :, 2::-1]  # stored blue first
            raster = upright(raster, _orientation(head))
            y, x = np.divmod(np.arange(raster.shape[0] * raster.shape[1], dtype=np.int32), np.int32(raster.shape[1]))
            flat = raster.reshape(-1, 3).astype(np.int32)
            for a in range(0, len(flat), 65536):
                part = flat[a : a + 65536]
                cols = [pa.array(np.full(len(part), image)), pa.array(y[a : a + 65536]), pa.array(x[a : a + 65536]), *(pa.array(np.ascontiguousarray(part[:, c])) for c in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["image_id", "y", "x", "r", "g", "b"])


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, modified, length) of the image files below a folder, numbered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_SUFFIXES))
    return files.select(F.xxhash64("path").alias("image_id"), "path", "modified", "length")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, y, x, r, g, b) of all decodable images below a folder, upright; image_id is a hash of the path."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), F.substring("content", 1, 65536).alias("head"))
    rows = images.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("p"), "image.height", "image.width", "image.nChannels", "image.data").join(heads, "p")
    return rows.select(F.xxhash64("p").alias("image_id"), "height", "width", "nChannels", "data", "head").mapInArrow(_pixels, "image_id long, y int, x int, r int, g int, b int")


def resized(pixels: DataFrame, longest: int, channels: tuple[str, ...] = ("r", "g", "b"), lobes: int = 3) -> DataFrame:
    """Images scaled to a longest side of at most `longest` pixels, one axis after the other, by windowed-sinc weights. Other
    columns than the channels are not read."""
    pixels = pixels.select("image_id", "y", "x", *channels)
    frame = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("w", "h"))
    frame = frame.select("image_id", "w", "h", *(F.greatest(F.lit(2), F.rint(F.col(s) * scale).cast("int")).alias(f"{s}2") for s in "wh"))

    def axis(df: DataFrame, place: str, size: str) -> DataFrame:
        other = "y" if place == "x" else "x"
        ratio = F.greatest(F.lit(1.0), F.col(size) / F.col(f"{size}2"))
        step = F.col(size) / F.col(f"{size}2")
        low, high = (F.col(place) + 0.5 - ratio * lobes) / step - 0.5, (F.col(place) + 0.5 + ratio * lobes) / step - 0.5
        targets = F.sequence(F.greatest(F.lit(0), F.ceil(low).cast("int")), F.least(F.col(f"{size}2") - 1, F.floor(high).cast("int")))
        df = df.withColumn("t", F.explode(F.when(low <= high, targets)))
        z = (F.col(place) + 0.5 - (F.col("t") + 0.5) * step) / ratio
        sinc = lambda v: F.when(F.abs(v) < 1e-9, 1.0).otherwise(F.sin(v * np.pi) / (v * np.pi))
        df = df.withColumn("k", F.when(F.abs(z) < lobes, sinc(z) * sinc(z / lobes)).otherwise(0.0))
        sums = [(F.sum(F.col("k") * F.col(c)) / F.sum("k")).alias(c) for c in channels]
        return df.groupBy("image_id", other, F.col("t").alias(place), "w", "h", "w2", "h2").agg(*sums)

    out = axis(axis(pixels.join(frame, "image_id"), "x", "w"), "y", "h")
    return out.select("image_id", "y", "x", *(F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c))).cast("int").alias(c) for c in channels))


def frames(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of dense rasters."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Row numbers from 1 in a stated order. Rows are dealt out by range, numbered within their range, and shifted by the
    sizes of the ranges before, so no task sees more than its range; ranges are few and stand in one table."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn("id", F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
