"""Scan conversion of paths, and what of its pixels a drawn field loses or gains.

A path becomes short lines, a line its crossings with the centres of pixel rows, and a row's crossings, in pairs from the left,
runs of pixels: even-odd filling, whatever number of loops a path has and however they nest. All steps are expressions over
rows; a window never holds more than the crossings of one path with one row.

Defined results: a null or empty path covers nothing; lines along a row and loops without area cross nothing; a loop that is
not closed is closed; a pixel is covered if its centre is inside, and of a centre exactly on an edge the left and upper edges
count. Other columns than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.scalars import _NUMBER
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL

#: Lines that take the place of a Bezier segment.
PIECES = 8


def segments(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(image_id, key, loop, seq, p: the eight numbers of a cubic segment) of paths of M, C and Z commands in absolute numbers;
    the last segment of a loop leads back to its start."""
    loops = paths.select("image_id", key, F.posexplode(F.filter(F.split(path, "[Zz]"), lambda t: F.trim(t) != "")).alias("loop", "_t"))
    numbers = F.transform(F.regexp_extract_all("_t", F.lit(f"({_NUMBER})"), 1), lambda v: v.cast("double"))
    loops = loops.select("image_id", key, "loop", numbers.alias("n")).where(F.size("n") >= 2)
    last = F.size("n") - 2
    way_back = F.concat(*(F.slice("n", c, 2) for c in (F.size("n") - 1, F.size("n") - 1, F.lit(1), F.lit(1))))
    starts = F.when(last >= 6, F.transform(F.sequence(F.lit(1), last - 5, F.lit(6)), lambda i: F.slice("n", i, 8))).otherwise(F.array().cast("array<array<double>>"))
    return loops.select("image_id", key, "loop", F.posexplode(F.array_append(starts, way_back)).alias("seq", "p"))


def crossing(cubics: DataFrame, slack: float = 1e-6) -> DataFrame:
    """The segments whose handles and ends have the centre of a pixel row between them, or all but: no other is filled by."""
    ends = [F.col("p")[k] for k in (1, 3, 5, 7)]
    return cubics.where(F.ceil(F.least(*ends) - 0.5 - slack) <= F.floor(F.greatest(*ends) - 0.5 + slack))


def flattened(cubics: DataFrame, key: str, pieces: int = PIECES) -> DataFrame:
    """(image_id, key, x0, y0, x1, y1): each segment as so many lines of equal parameter."""

    def at(t, axis: int):
        a, b, c, d = (F.col("p")[2 * k + axis] for k in range(4))
        u = F.lit(1.0) - t
        return a * u * u * u + b * (u * u * t * 3.0) + c * (u * t * t * 3.0) + d * t * t * t

    rows = cubics.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    here, there = F.col("_k") / float(pieces), (F.col("_k") + 1) / float(pieces)
    return rows.select("image_id", key, *(at(t, axis).alias(f"{c}{i}") for i, t in ((0, here), (1, there)) for axis, c in enumerate("xy")))


def scan_filled(lines: DataFrame, key: str) -> DataFrame:
    """(image_id, key, y, x0, x1): runs of pixels, both ends included, inside of closed lines (image_id, key, x0, y0, x1, y1)."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low - 0.5).cast("int"), F.ceil(high - 0.5).cast("int") - 1
    rows = lines.where("y0 <> y1").withColumns({"_a": first, "_b": last}).where("_a <= _b")
    rows = rows.withColumn("y", F.explode(F.sequence("_a", "_b")))
    x = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    w = Window.partitionBy("image_id", key, "y").orderBy("x")
    crossings = rows.select("image_id", key, "y", x.alias("x")).withColumns({"_n": F.row_number().over(w), "_to": F.lead("x").over(w)})
    runs = crossings.where("_n % 2 = 1 and _to is not null").select("image_id", key, "y", F.ceil(F.col("x") - 0.5).cast("int").alias("x0"), (F.ceil(F.col("_to") - 0.5) - 1).cast("int").alias("x1"))
    return runs.where("x0 <= x1")


def covered_pixels(runs: DataFrame, key: str, frames: DataFrame) -> DataFrame:
    """(pixel, key) of runs within the frame."""
    inside = runs.join(frames.select("image_id", "width", "height"), "image_id").where("y >= 0 and y < height")
    inside = inside.select("image_id", key, "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least(F.col("x1"), F.col("width").cast("int") - 1).alias("x1")).where("x0 <= x1")
    return inside.select("image_id", key, "y", F.explode(F.sequence("x0", "x1")).alias("x")).select(*PIXEL, key)


def audit(fields: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(image_id, key, pixels, covered, lost, leaked): of fields (pixel, key) and drawn pixels (pixel, key), those that are in
    one and not in the other. A field that is not drawn loses all of its pixels."""
    one = fields.select(*PIXEL, key).distinct().withColumn("_f", F.lit(1))
    two = drawn.select(*PIXEL, key).distinct().withColumn("_d", F.lit(1))
    both = one.join(two, [*PIXEL, key], "full")
    return both.groupBy("image_id", key).agg(F.count("_f").alias("pixels"), F.count("_d").alias("covered"), F.count_if(F.col("_d").isNull()).alias("lost"), F.count_if(F.col("_f").isNull()).alias("leaked"))


def micro_holes(drawn: DataFrame, frames: DataFrame, most: int) -> DataFrame:
    """(image_id, component, area): enclosed parts of at most so many pixels that no drawn pixel covers: the ground shows through."""
    inner = K.holes(drawn.select(PIXEL).distinct(), frames)
    return inner.groupBy("image_id", "component").agg(F.count("*").alias("area")).where(F.col("area") <= most)
