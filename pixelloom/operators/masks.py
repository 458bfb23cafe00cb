"""Masks are sets of rows (image_id, y, x); their algebra is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["image_id", "y", "x"]


def mask_where(pixels: DataFrame, condition: Column) -> DataFrame:
    return pixels.where(condition).select(PIXEL)


def above_percentile(pixels: DataFrame, value: str, share: float, least: float) -> DataFrame:
    """Pixels at or above both a percentile of their image and a fixed floor."""
    limit = pixels.groupBy("image_id").agg(F.greatest(F.lit(float(least)), F.percentile(value, F.lit(share))).alias("limit"))
    return pixels.join(limit.hint("merge"), "image_id").where(F.col(value) >= F.col("limit")).select(PIXEL)


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(PIXEL)
    for m in masks[1:]:
        out = out.unionByName(m.select(PIXEL))
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(PIXEL).join(b.select(PIXEL).hint("merge"), PIXEL, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(PIXEL).join(b.select(PIXEL).hint("merge"), PIXEL, "left_anti")


def frame_grid(frames: DataFrame) -> DataFrame:
    """All pixels of frames (image_id, width, height)."""
    rows = frames.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def complement(mask: DataFrame, frames: DataFrame) -> DataFrame:
    return difference(frame_grid(frames), mask)


def claimed(layers: DataFrame, frames: DataFrame, share: float = 0.003, floor: int = 16) -> DataFrame:
    """layers (image_id, y, x, priority) with each pixel given to the first layer that has it; layers left with fewer than
    max(floor, share of the frame) pixels are dropped."""
    first = layers.groupBy(PIXEL).agg(F.min("priority").alias("priority"))
    size = first.groupBy("image_id", "priority").agg(F.count("*").alias("n"))
    keep = size.join(frames, "image_id").where(F.col("n") >= F.greatest(F.lit(float(floor)), F.col("width") * F.col("height") * share)).select("image_id", "priority")
    return first.join(keep, ["image_id", "priority"], "left_semi").select(*PIXEL, "priority")


def overwritten(labels: DataFrame, claims: DataFrame, column: str = "label", new: str = "priority", offset: int = 0) -> DataFrame:
    """labels with the label of claims where there is one."""
    found = claims.select(*PIXEL, (F.col(new) + offset).alias("_new"))
    return labels.join(found.hint("merge"), PIXEL, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def touched_edges(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, edges): the frame's edges that a mask touches, as an ordered array of names."""
    flags = mask.join(frames, "image_id").groupBy("image_id").agg(F.bool_or(F.col("x") == 0).alias("left"), F.bool_or(F.col("x") == F.col("width") - 1).alias("right"), F.bool_or(F.col("y") == 0).alias("top"), F.bool_or(F.col("y") == F.col("height") - 1).alias("bottom"))
    return flags.select("image_id", F.filter(F.array(*(F.when(F.col(e), e) for e in ("left", "right", "top", "bottom"))), lambda e: e.isNotNull()).alias("edges"))


def zone(df: DataFrame, frames: DataFrame, x: tuple[float, float] = (0, 1), y: tuple[float, float] = (0, 1)) -> DataFrame:
    """Rows inside shares of the frame, ends included."""
    out = df.join(frames, "image_id").where((F.col("x") >= F.col("width") * x[0]) & (F.col("x") <= F.col("width") * x[1]) & (F.col("y") >= F.col("height") * y[0]) & (F.col("y") <= F.col("height") * y[1]))
    return out.drop("width", "height")


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def within_keys(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def mirrored(df: DataFrame, axis: Column) -> DataFrame:
    """Rows reflected about a horizontal axis; what falls outside above is dropped."""
    return df.withColumn("y", (axis * 2 - 1 - F.col("y")).cast("int")).where(F.col("y") >= 0)


def first_claim(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
