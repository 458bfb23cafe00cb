"""Grouped statistics over pixel tables: quantiles, entropy, edges, correlations, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.stencils import column_window, row_window


def median_color(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Median colour of each group, rounded half to even."""
    return pixels.groupBy(*keys).agg(*(F.rint(F.median(c)).cast("int").alias(c) for c in "rgb"), F.count("*").alias("population"))


def percentile_color(pixels: DataFrame, keys: list[str], share: float) -> DataFrame:
    return pixels.groupBy(*keys).agg(*(F.rint(F.percentile(c, F.lit(share))).cast("int").alias(c) for c in "rgb"))


def stops(pixels: DataFrame, value: str, shares: tuple[float, ...] = (0.18, 0.46, 0.54, 0.82)) -> DataFrame:
    """Quantiles of a value for each image, in columns p18, p46..."""
    return pixels.groupBy("image_id").agg(*(F.percentile(value, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares))


def populations(labels: DataFrame, label: str = "label") -> DataFrame:
    """Pixels of each label and their share of the image, to six places."""
    n = labels.groupBy("image_id", label).agg(F.count("*").alias("population"))
    return n.withColumn("fraction", F.round(F.col("population") / F.sum("population").over(Window.partitionBy("image_id")), 6))


def reconciled(fractions: DataFrame, order: str, value: str = "fraction") -> DataFrame:
    """Fractions of an image whose last row takes what is missing to one."""
    w = Window.partitionBy("image_id")
    last = F.col(order) == F.max(order).over(w)
    rest = F.sum(F.when(~last, F.col(value))).over(w)
    return fractions.withColumn("_last", last).withColumn(value, F.when(F.col("_last"), F.round(F.lit(1.0) - F.coalesce(rest, F.lit(0.0)), 6)).otherwise(F.col(value))).drop("_last")


def entropy(labels: DataFrame, label: str = "label", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Shannon entropy of the labels over that of as many equally likely ones."""
    n = labels.groupBy(*keys, label).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    out = p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.greatest(F.lit(2), F.max(label) + 1).alias("k"))
    return out.select(*keys, (F.col("h") / F.log(F.col("k").cast("double"))).alias("entropy"))


def purity(labels: DataFrame, label: str, keys: list[str]) -> DataFrame:
    n = labels.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("purity"), F.max_by(label, F.struct("n", -F.col(label))).alias("top"))


def row_residual(pixels: DataFrame, value: str, out: str = "residual") -> DataFrame:
    """A value minus the median of its row. Rows are short, whatever the number of images."""
    med = pixels.groupBy("image_id", "y").agg(F.median(value).alias("_m"))
    return pixels.join(med.hint("merge"), ["image_id", "y"]).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def quadrants(frames_joined: DataFrame) -> DataFrame:
    """Adds quadrant 0..3 in reading order; needs width and height."""
    return frames_joined.withColumn("quadrant", (F.col("y") >= F.floor(F.col("height") / 2)).cast("int") * 2 + (F.col("x") >= F.floor(F.col("width") / 2)).cast("int"))


def edge_recall(pixels: DataFrame, keys: list[str], gradient: str, near: str, share: float = 0.88) -> DataFrame:
    """Of the gradient above a quantile, the share that lies near a label boundary."""
    limit = pixels.groupBy(*keys).agg(F.percentile(gradient, F.lit(share)).alias("limit"))
    strong = F.when(F.col(gradient) >= F.col("limit"), F.col(gradient)).otherwise(0.0)
    return pixels.join(limit.hint("merge"), keys).groupBy(*keys).agg((F.sum(F.when(F.col(near), strong).otherwise(0.0)) / F.greatest(F.sum(strong), F.lit(1e-9))).alias("recall"))


def edge_mode(labels: DataFrame, frames: DataFrame, label: str = "label", share: float = 0.035) -> DataFrame:
    """(image_id, background): the commonest label of the top, left and right bands; a corner counts in each band it is in."""
    depth = F.greatest(F.lit(1), F.rint(F.least("width", "height") * share).cast("int"))
    rows = labels.join(frames, "image_id").withColumn("depth", depth)
    times = (F.col("y") < F.col("depth")).cast("int") + (F.col("x") < F.col("depth")).cast("int") + (F.col("x") >= F.col("width") - F.col("depth")).cast("int")
    n = rows.withColumn("times", times).where("times > 0").groupBy("image_id", label).agg(F.sum("times").alias("n"))
    return n.groupBy("image_id").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("background"))


def normalised_correlation(pairs: DataFrame, keys: list[str], a: str, b: str, floor: float = 1e-6) -> DataFrame:
    """Mean product of standardised values; deviations below the floor are raised to it."""
    s = pairs.groupBy(*keys).agg(F.avg(F.col(a) * F.col(b)).alias("ab"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return s.select(*keys, ((F.col("ab") - F.col("ma") * F.col("mb")) / (F.greatest(F.col("sa"), F.lit(floor)) * F.greatest(F.col("sb"), F.lit(floor)))).alias("correlation"))


def mirror_correlation(pixels: DataFrame, value: str, axis: DataFrame) -> DataFrame:
    """Correlation of the rows above an axis with the mirrored ones below; axis (image_id, axis)."""
    rows = pixels.select("image_id", "y", "x", value).join(axis, "image_id")
    below = rows.where("y >= axis").select("image_id", "axis", (F.col("axis") * 2 - 1 - F.col("y")).cast("int").alias("y"), "x", F.col(value).alias("_mirror"))
    return normalised_correlation(rows.where("y < axis").join(below.hint("merge"), ["image_id", "axis", "y", "x"]), ["image_id", "axis"], value, "_mirror")


def line_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y over x, and the median absolute residual."""
    fit = points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    off = points.join(fit.hint("merge"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("error"))
    return fit.join(off, keys)


def spread(pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median distance of a group's pixels from its median."""
    mid = pixels.groupBy(*keys).agg(*(F.median(v).alias(f"_{v}") for v in values))
    gap = [(F.col(v) - F.col(f"_{v}")) * (F.col(v) - F.col(f"_{v}")) for v in values]
    return pixels.join(mid.hint("merge"), keys).groupBy(*keys).agg(F.median(F.sqrt(sum(gap[1:], gap[0]))).alias("spread"))


def rarity(pixels: DataFrame, centres: DataFrame, values: list[str], within: float = 0.035) -> DataFrame:
    """Share of an image's pixels within a distance of each centre (image_id, component, values)."""
    c = centres.select("image_id", "component", *(F.col(v).alias(f"_{v}") for v in values))
    gap = [(F.col(v) - F.col(f"_{v}")) * (F.col(v) - F.col(f"_{v}")) for v in values]
    return pixels.join(c.hint("merge"), "image_id").groupBy("image_id", "component").agg(F.avg((F.sqrt(sum(gap[1:], gap[0])) <= within).cast("double")).alias("rarity"))


def islands(rows: DataFrame, keys: list[str], place: str, least: int = 3) -> DataFrame:
    """Runs of consecutive places: (keys, first, last, size), of at least `least` members."""
    w = Window.partitionBy(*keys).orderBy(place)
    runs = rows.select(*keys, place).distinct().withColumn("_g", F.col(place) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("size")).where(F.col("size") >= least).drop("_g")


def counters(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """A map name -> value for each group; names are unique within it."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("counters"))


def best(rows: DataFrame, keys: list[str], score: str | Column, tie: str | Column, columns: list[str]) -> DataFrame:
    """The row of the greatest score in each group, the smallest tie value of equal ones."""
    score, tie = (F.col(c) if isinstance(c, str) else c for c in (score, tie))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(score, -tie)).alias("_b")).select(*keys, "_b.*")


def row_step(value: str) -> Column:
    return F.col(value) - F.lag(value).over(row_window())


def column_step(value: str) -> Column:
    return F.col(value) - F.lag(value).over(column_window())
