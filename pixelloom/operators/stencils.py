"""Neighbourhood operators. Each works along one axis at a time: two shuffles of narrow rows, whatever the kernel's size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.masks import PIXEL, complement, frame_grid


def row_window(image: str = "image_id"):
    return Window.partitionBy(image, "y").orderBy("x")


def column_window(image: str = "image_id"):
    return Window.partitionBy(image, "x").orderBy("y")


def shifted(value: str | Column, by: int, axis: str = "x") -> Column:
    """The value `by` places on along an axis; beyond the edge, the edge's."""
    w = row_window() if axis == "x" else column_window()
    value = F.col(value) if isinstance(value, str) else value
    if by == 0:
        return value
    edge = F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing)) if by > 0 else F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.lead(value, by).over(w) if by > 0 else F.lag(value, -by).over(w), edge)


def weights(radius: float) -> list[float]:
    """A Gaussian cut at three standard deviations, summing to one; index 0 is the centre."""
    reach = max(1, math.ceil(3 * radius))
    w = [math.exp(-0.5 * (d / radius) ** 2) for d in range(reach + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def convolved(df: DataFrame, value: str, kernel: list[float], axis: str, out: str | None = None) -> DataFrame:
    """Symmetric convolution along an axis, edges extended; kernel[0] is the centre."""
    total = F.col(value) * kernel[0]
    for d, w in enumerate(kernel[1:], 1):
        total = total + (shifted(value, -d, axis) + shifted(value, d, axis)) * w
    return df.withColumn(out or value, total)


def gaussian(df: DataFrame, value: str, radius: float, out: str | None = None) -> DataFrame:
    k = weights(radius)
    return convolved(convolved(df, value, k, "x", out), out or value, k, "y")


def blurred(df: DataFrame, value: str, radius: Column) -> DataFrame:
    """(pixel, value): as gaussian, with a radius that follows the frame: a column of width and height. A task holds lines of
    pixels, edges extended; pixels that a line lacks are passed over."""
    rows = df.select(*PIXEL, F.col(value).cast("double").alias("v"), radius.cast("double").alias("radius"))
    for line, place in (("y", "x"), ("x", "y")):
        rows = rows.groupBy("image_id", line).agg(F.array_sort(F.collect_list(F.struct(place, "v"))).alias("cells"), F.first("radius").alias("radius"))
        rows = rows.withColumn("line", F.transform("cells", lambda c: c["v"]))
        reach = F.greatest(F.lit(1), F.ceil(F.col("radius") * 3).cast("int"))
        rows = rows.withColumn("taps", F.transform(F.sequence(-reach, reach), lambda d: F.struct(d.alias("d"), F.exp(-0.5 * F.pow(d / F.col("radius"), F.lit(2))).alias("w"))))
        rows = rows.withColumn("total", F.aggregate("taps", F.lit(0.0), lambda s, t: s + t["w"]))
        last = F.size("line") - 1
        cell = lambda i: F.aggregate("taps", F.lit(0.0), lambda s, t: s + t["w"] * F.element_at("line", F.greatest(F.lit(0), F.least(last, i + t["d"])) + 1)) / F.col("total")  # noqa: E731, B023
        rows = rows.select("image_id", line, "radius", F.inline(F.transform("cells", lambda c, i: F.struct(c[place].alias(place), cell(i).alias("v")))))  # noqa: B023
    return rows.select(*PIXEL, F.col("v").alias(value))


def extreme(df: DataFrame, value: str, size: int, how: str) -> DataFrame:
    """Maximum or minimum over a square of odd size; absent neighbours are ignored."""
    k, f = size // 2, {"max": F.max, "min": F.min}[how]
    for w in (row_window(), column_window()):
        df = df.withColumn(value, f(value).over(w.rangeBetween(-k, k)))
    return df


def dilated(mask: DataFrame, size: int | Column, frames: DataFrame | None = None) -> DataFrame:
    """A mask grown by a square of odd size, inside the frame if one is given. A size that follows the frame is a column of
    its width and height."""
    if isinstance(size, Column):
        reach = frames.select("image_id", "width", "height", F.floor(size / 2).cast("int").alias("_k"))
        along = lambda c, limit: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("_k")), F.least(F.col(limit) - 1, F.col(c) + F.col("_k")))).alias(c)
        out = mask.select(PIXEL).join(reach, "image_id").select("image_id", "y", along("x", "width"), "height", "_k").distinct()
        return out.select("image_id", along("y", "height"), "x").distinct()
    k = size // 2
    around = lambda c: F.explode(F.sequence(F.col(c) - k, F.col(c) + k)).alias(c)
    out = mask.select("image_id", "y", around("x")).distinct().select("image_id", around("y"), "x").distinct()
    if frames is None:
        return out.select(PIXEL)
    return out.join(frames, "image_id").where("x >= 0 and y >= 0 and x < width and y < height").select(PIXEL)


def eroded(mask: DataFrame, size: int | Column, frames: DataFrame) -> DataFrame:
    """A mask shrunk by a square of odd size; what is outside the frame does not count against it."""
    if isinstance(size, Column):
        return mask.select(PIXEL).join(dilated(complement(mask, frames), size, frames).hint("merge"), PIXEL, "left_anti")
    k = size // 2
    out = mask.join(frames, "image_id")
    for c, limit, w in (("x", "width", row_window()), ("y", "height", column_window())):
        full = F.least(F.col(c) + k, F.col(limit) - 1) - F.greatest(F.col(c) - k, F.lit(0)) + 1
        out = out.withColumn("_n", F.count("*").over(w.rangeBetween(-k, k))).where(F.col("_n") == full)
    return out.select(PIXEL)


def closed(mask: DataFrame, size: int | Column, frames: DataFrame, shrink: int | None = None) -> DataFrame:
    return eroded(dilated(mask, size, frames), shrink or size, frames)


def opened(mask: DataFrame, size: int | Column, frames: DataFrame) -> DataFrame:
    return dilated(eroded(mask, size, frames), size, frames)


def mode(df: DataFrame, value: str, size: int, frames: DataFrame) -> DataFrame:
    """The most frequent value of a square of odd size, the smallest of equally frequent ones. Counts are summed along one
    axis and then the other, so a pixel sends size rows twice instead of size squared."""
    k = size // 2
    across = df.select("image_id", "y", F.explode(F.sequence(F.col("x") - k, F.col("x") + k)).alias("x"), value).groupBy(*PIXEL, value).agg(F.count("*").alias("n"))
    both = across.select("image_id", F.explode(F.sequence(F.col("y") - k, F.col("y") + k)).alias("y"), "x", value, "n").groupBy(*PIXEL, value).agg(F.sum("n").alias("n"))
    best = both.groupBy(PIXEL).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))
    return best.join(frames, "image_id").where("x >= 0 and y >= 0 and x < width and y < height").select(*PIXEL, value)


def cleaned(mask: DataFrame, closing: int, mode_size: int, frames: DataFrame) -> DataFrame:
    """Closing, then majority."""
    shut = closed(mask, closing, frames)
    k = mode_size // 2
    across = shut.select("image_id", "y", F.explode(F.sequence(F.col("x") - k, F.col("x") + k)).alias("x")).groupBy(PIXEL).agg(F.count("*").alias("n"))
    both = across.select("image_id", F.explode(F.sequence(F.col("y") - k, F.col("y") + k)).alias("y"), "x", "n").groupBy(PIXEL).agg(F.sum("n").alias("n"))
    cells = (F.least(F.col("x") + k, F.col("width") - 1) - F.greatest(F.col("x") - k, F.lit(0)) + 1) * (F.least(F.col("y") + k, F.col("height") - 1) - F.greatest(F.col("y") - k, F.lit(0)) + 1)
    return both.join(frames, "image_id").where("x >= 0 and y >= 0 and x < width and y < height").where(F.col("n") * 2 > cells).select(PIXEL)


def smoothed_boundary(mask: DataFrame, radius: float | Column, frames: DataFrame) -> DataFrame:
    """A mask blurred and cut at one half."""
    dense = frame_grid(frames).join(mask.select(*PIXEL, F.lit(1.0).alias("v")).hint("merge"), PIXEL, "left").na.fill(0.0, ["v"])
    soft = blurred(dense.join(frames, "image_id"), "v", radius) if isinstance(radius, Column) else gaussian(dense, "v", radius)
    return soft.where("v >= 0.5").select(PIXEL)


def rounded_tips(mask: DataFrame, size: int | Column, frames: DataFrame, least: int = 64, share: float = 0.72) -> DataFrame:
    """Opening within the mask, kept only for images where enough of the mask is left."""
    new = opened(mask, size, frames).join(mask.select(PIXEL).hint("merge"), PIXEL, "left_semi")
    counts = mask.groupBy("image_id").agg(F.count("*").alias("n")).join(new.groupBy("image_id").agg(F.count("*").alias("m")), "image_id", "left")
    good = counts.where(F.coalesce("m", F.lit(0)) >= F.greatest(F.lit(float(least)), F.col("n") * share)).select("image_id")
    return new.join(good, "image_id", "left_semi").unionByName(mask.select(PIXEL).join(good, "image_id", "left_anti"))


def gap_closed(mask: DataFrame, size: int | Column, frames: DataFrame) -> DataFrame:
    """(pixel, added): closing that only ever adds; added marks the new pixels."""
    whole = closed(mask, size, frames).select(*PIXEL, F.lit(True).alias("added")).unionByName(mask.select(*PIXEL, F.lit(False).alias("added")))
    return whole.groupBy(PIXEL).agg(F.min("added").alias("added"))


def seam_overlap(field: DataFrame, occluder: DataFrame, clearance: int | Column, margin: int | Column, frames: DataFrame) -> DataFrame:
    """Pixels by which a field is extended under an occluder it nearly touches."""
    near = dilated(field, (clearance + margin) * 2 + 1, frames).join(dilated(occluder, clearance * 2 + 1, frames).hint("merge"), PIXEL, "left_semi")
    return near.join(field.select(PIXEL).hint("merge"), PIXEL, "left_anti")


def reflected_mean(df: DataFrame, value: str, radius: Column, out: str) -> DataFrame:
    """Mean over radius pixels to either side in a row, the row mirrored at its ends without repeating them."""
    rows = df.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.col(value).cast("double").alias("v")))).alias("cells"), radius.alias("r"))
    n = F.size("cells")

    def at(i: Column) -> Column:
        i = F.abs(i)
        return F.element_at("cells", F.when(i > n - 1, 2 * (n - 1) - i).otherwise(i).cast("int") + 1)["v"]

    means = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.element_at("cells", x.cast("int") + 1)["x"].alias("x"), (F.aggregate(F.sequence(x - F.col("r"), x + F.col("r")), F.lit(0.0), lambda s, j: s + at(j)) / (F.col("r") * 2 + 1)).alias(out)))
    return rows.select("image_id", "y", F.inline(means))


def central_gradient(value: str, axis: str) -> Column:
    """Central differences inside, one-sided at the ends."""
    w = row_window() if axis == "x" else column_window()
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2.0)


def gradient_magnitude(df: DataFrame, value: str, out: str = "gradient") -> DataFrame:
    df = df.withColumn("_gx", central_gradient(value, "x")).withColumn("_gy", central_gradient(value, "y"))
    return df.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def vertical_delta(df: DataFrame, values: list[str], out: str = "delta") -> DataFrame:
    """Distance of a pixel's values from those of the pixel above; null in the first row."""
    gaps = [F.col(v) - F.lag(v).over(column_window()) for v in values]
    return df.withColumn(out, F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])))


def boundaries(df: DataFrame, label: str, out: str = "boundary") -> DataFrame:
    """Whether a label differs from that on the left or above."""
    left, up = F.lag(label).over(row_window()), F.lag(label).over(column_window())
    return df.withColumn(out, F.coalesce(F.col(label) != left, F.lit(False)) | F.coalesce(F.col(label) != up, F.lit(False)))


def band_contrast(df: DataFrame, value: str, above: tuple[int, int] = (-7, -3), below: tuple[int, int] = (2, 7), out: str = "contrast") -> DataFrame:
    """Mean below a pixel minus mean above it, over bands of its column."""
    return df.withColumn(out, F.avg(value).over(column_window().rowsBetween(*below)) - F.avg(value).over(column_window().rowsBetween(*above)))


def high_pass(df: DataFrame, value: str, radius: float = 2.3, out: str = "detail") -> DataFrame:
    return gaussian(df.withColumn(out, F.col(value).cast("double")), out, radius).withColumn(out, F.col(value) - F.col(out))


def envelope(series: DataFrame, value: str, reach: int, keep: float = 0.35, keys: tuple[str, ...] = ("image_id",), order: str = "x", out: str = "envelope") -> DataFrame:
    """Running minimum then maximum of a series, blended with the series itself."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return series.withColumn("_low", F.min(value).over(w)).withColumn(out, F.col(value) * keep + F.max("_low").over(w) * (1 - keep)).drop("_low")
