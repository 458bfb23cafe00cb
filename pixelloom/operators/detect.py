"""Detectors: what kind of scene an image is and which small features of it must survive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import aggregates, geometry, joins, masks, stencils
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL

_LAB = ["L", "a", "bb"]


def with_oklab(pixels: DataFrame) -> DataFrame:
    return pixels.select("*", *(c.alias(n) for c, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), ("L", "a", "bb"), strict=True)))


def heights(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"))


def night_gate(pixels: DataFrame) -> DataFrame:
    """(image_id, top, low_warm, top_warm, night): a dark upper part over a warmer lower part."""
    pixels = pixels.select(*PIXEL, "r", "g", "b")
    rows = pixels.join(heights(pixels).hint("merge"), "image_id")
    upper, lower = F.col("y") < F.col("height") * 0.58, F.col("y") >= F.col("height") * 0.45
    warm = color.warmth(F.col("r"), F.col("b"))
    s = rows.groupBy("image_id").agg(F.avg(F.when(upper, color.luminance(F.col("r"), F.col("g"), F.col("b")))).alias("top"), F.percentile(F.when(lower, warm), F.lit(0.7)).alias("low_warm"), F.median(F.when(upper, warm)).alias("top_warm"))
    return s.withColumn("night", (F.col("top") < 82) & (F.col("low_warm") > F.col("top_warm") + 13))


def _likeness(one: list[str], two: list[str], floor: float = 1e-6) -> Column:
    """Correlation of the values of columns one with those of columns two, taken together, as an aggregate; deviations below
    the floor are raised to it."""
    mean = lambda of: sum((F.avg(c) for c in of[1:]), F.avg(of[0])) / len(of)
    product = lambda a, b: sum((F.avg(F.col(c) * F.col(d)) for c, d in zip(a[1:], b[1:], strict=True)), F.avg(F.col(a[0]) * F.col(b[0]))) / len(a)
    spread = lambda of: F.greatest(F.lit(floor), F.sqrt(F.greatest(F.lit(0.0), product(of, of) - mean(of) * mean(of))))
    return (product(one, two) - mean(one) * mean(two)) / (spread(one) * spread(two))


def reflection(pixels: DataFrame, frames: DataFrame, wide: float = 1.35) -> DataFrame:
    """(image_id, axis, light, chroma, edge, score, reflective): the best horizontal axis about which an image mirrors.

    Only images at least so wide, as a share of their height; 0: all. Lightness, chroma and edges of the rows above are compared with the mirrored rows below.
    """
    frames = frames.select("image_id", "width", "height")
    wide = frames.where(F.col("width") >= F.col("height") * wide)
    rows = with_oklab(pixels.select(*PIXEL, "r", "g", "b").join(wide, "image_id"))
    radius = F.greatest(F.lit(3.0), F.col("width") / 70.0)
    soft = rows.select(PIXEL)
    for c in ("L", "a", "bb"):
        soft = soft.join(stencils.blurred(rows, c, radius).hint("merge"), PIXEL)
    rows = K.stored(stencils.gradient_magnitude(soft, "L", "edge"))
    axes = wide.select("image_id", "height", F.explode(F.sequence(F.ceil(F.col("height") * 0.38).cast("int"), F.floor(F.col("height") * 0.64).cast("int"))).alias("axis"))
    depth = F.least(F.col("axis"), F.col("height") - F.col("axis"), F.floor(F.col("height") * 0.34).cast("int"))
    axes = axes.withColumn("depth", depth).where(F.col("depth") >= F.col("height") * 0.15)
    at = rows.select("image_id", "y", "x", "L", "a", "bb", "edge").join(axes, "image_id")
    top = at.where((F.col("y") < F.col("axis")) & (F.col("y") >= F.col("axis") - F.col("depth")))
    low = at.where((F.col("y") >= F.col("axis")) & (F.col("y") < F.col("axis") + F.col("depth"))).select("image_id", "axis", (F.col("axis") * 2 - 1 - F.col("y")).alias("y"), "x", *(F.col(c).alias(f"m_{c}") for c in ("L", "a", "bb", "edge")))
    pair = top.join(low.hint("merge"), ["image_id", "axis", "y", "x"])
    # one pass over the pairs; both channels of hue are pooled in one correlation
    out = pair.groupBy("image_id", "axis").agg(*(_likeness([c], [f"m_{c}"]).alias(c) for c in ("L", "edge")), _likeness(["a", "bb"], ["m_a", "m_bb"]).alias("tint"))
    step = rows.groupBy("image_id", "y").agg(F.avg("edge").alias("strength")).select("image_id", F.col("y").alias("axis"), "strength")
    out = out.join(step, ["image_id", "axis"])
    score = F.col("L") * 0.42 + F.col("tint") * 0.23 + F.col("edge") * 0.35 + F.col("strength") * 1.4
    best = aggregates.best(out.withColumn("score", score), ["image_id"], "score", "axis", ["axis", "L", "tint", "edge", "score"]).join(frames.select("image_id", "height"), "image_id")
    share = F.col("axis") / F.col("height")
    yes = (F.col("score") >= 0.72) & share.between(0.42, 0.58) & (F.col("L") >= 0.80) & (F.col("tint") >= 0.55) & (F.col("edge") >= 0.55)
    return best.select("image_id", "axis", F.col("L").alias("light"), F.col("tint").alias("chroma"), "edge", "score", yes.alias("reflective"))


def outer_contour(pixels: DataFrame, axes: DataFrame) -> DataFrame:
    """(image_id, x, top): the upper outline of the terrain above each image's axis (image_id, axis).

    A path from left to right follows a change of colour and the start of texture; it is smoothed, and narrow valleys are
    closed for the most part. Images with no room between the top and the axis have none.
    """
    keys = ["image_id", "height", "axis"]
    rows = pixels.select(*PIXEL, "r", "g", "b").join(axes.select("image_id", "axis"), "image_id")
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    fine = broad = rows.select(*PIXEL, *(F.col(c).cast("double").alias(c) for c in "rgb"))
    for c in "rgb":
        fine, broad = stencils.gaussian(fine, c, 1.2), stencils.gaussian(broad, c, 5.5)
    fine, broad = with_oklab(fine).select(*PIXEL, *(F.col(c).alias(f"f{c}") for c in _LAB)), with_oklab(broad).select(*PIXEL, *_LAB)
    rows = K.stored(broad.join(fine.hint("merge"), PIXEL).withColumn("texture", _gap("", "f")).select(*PIXEL, *_LAB, "texture"))
    column = stencils.column_window()
    mean = lambda c, low, high: F.avg(c).over(column.rowsBetween(low, high))
    jump = F.sqrt(sum((F.pow(mean(c, 2, 7) - mean(c, -7, -3), F.lit(2)) for c in _LAB[1:]), F.pow(mean("L", 2, 7) - mean("L", -7, -3), F.lit(2))))
    edge = F.sqrt(sum((F.pow(F.lead(c).over(column) - F.lag(c).over(column), F.lit(2)) for c in _LAB[1:]), F.pow(F.lead("L").over(column) - F.lag("L").over(column), F.lit(2))))
    score = jump * 1.25 + edge * 1.8 + (mean("texture", 2, 8) - mean("texture", -8, -3)) * 3.0 - F.col("y") * 0.0011
    low = F.greatest(F.lit(4), F.rint(F.col("height") * 0.015).cast("int"))
    scores = rows.withColumn("score", score).join(size, "image_id").join(axes.select("image_id", "axis"), "image_id").where((F.col("y") >= low) & (F.col("y") <= F.col("axis") - 7))
    border = (F.col("x") < 3) | (F.col("x") >= F.col("width") - 3)
    line = K.stored(geometry.contours(scores.withColumn("score", F.when(border, F.col("score") * 1.12).otherwise(F.col("score"))), "score", "height").select("image_id", "x", F.lit(0).alias("y"), F.col("y").cast("double").alias("top")))
    bell = [math.exp(-0.5 * (d / 4.0) ** 2) for d in range(13)]
    total = bell[0] + 2 * sum(bell[1:])
    line = stencils.convolved(line, "top", [w / total for w in bell], "x").select("image_id", "x", F.rint("top").alias("top")).join(size.join(axes.select("image_id", "axis"), "image_id"), "image_id")
    reach = F.greatest(F.lit(9), F.rint(F.col("width") * 0.085).cast("int"))
    line = K.stored(line.withColumn("low", low).withColumn("reach", reach))

    def running(series: DataFrame, value: str, how, out: str) -> DataFrame:
        near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - F.col("reach")), F.least(F.col("width") - 1, F.col("x") + F.col("reach")))).alias("x")
        return series.select("image_id", near, value).groupBy("image_id", "x").agg(how(value).alias(out))

    opened = running(line.select("image_id", "x", "width", "reach").join(running(line, "top", F.min, "least").hint("merge"), ["image_id", "x"]), "least", F.max, "opened")
    rows = line.join(opened.hint("merge"), ["image_id", "x"])
    top = F.rint(F.col("top") * 0.35 + F.least("top", "opened") * 0.65)
    return rows.select("image_id", "x", F.greatest(F.col("low"), F.least(F.col("axis") - 7, top)).cast("int").alias("top"))


def quadrant_confidence(labelled: DataFrame, frames: DataFrame, margin: str = "margin") -> DataFrame:
    """(image_id, quadrant, confidence): how far labels follow the image. Weighs edge recall, label coherence and the mean
    margin between the two nearest roles; collapsed and fragmented quadrants lose."""
    rows = stencils.boundaries(stencils.gradient_magnitude(labelled, "L", "gradient"), "label")
    rows = aggregates.quadrants(rows.join(frames, "image_id"))
    rows = K.stored(rows)
    keys = ["image_id", "quadrant"]
    recall = aggregates.edge_recall(rows, keys, "gradient", "boundary")
    ent = aggregates.entropy(rows, "label", ("image_id", "quadrant"))
    sub = K.components(rows.select((F.col("image_id") * 4 + F.col("quadrant")).alias("image_id"), "y", "x", "label"), "label")
    coh = K.coherence(sub, "label").select(F.floor(F.col("image_id") / 4).alias("image_id"), F.pmod("image_id", F.lit(4)).cast("int").alias("quadrant"), "coherence")
    mean = rows.groupBy(*keys).agg(F.avg(margin).alias("margin"), F.avg(F.col("gradient") * F.col("gradient")).alias("energy"))
    s = recall.join(ent, keys).join(coh, keys).join(mean, keys)
    collapsed = (F.col("recall") < 0.48) & (F.col("entropy") < 0.55) & (F.col("energy") > 0.0045)
    fragmented = (F.col("coherence") < 0.80) & (F.col("margin") < 0.58) & (F.col("recall") < 0.68) & (F.col("energy") > 0.0040)
    base = F.col("recall") * 0.45 + F.col("coherence") * 0.30 + F.col("margin") * 0.25
    return s.select(*keys, (base - F.when(collapsed | fragmented, 0.16).otherwise(0.0)).alias("confidence"))


def _grid(low: float, high: float, size: str, step: float, least: int) -> Column:
    """Places from a share of the size up to but without another, a share of it apart."""
    at = lambda share: F.rint(F.col(size) * share).cast("int")
    return F.sequence(at(low), at(high) - 1, F.greatest(F.lit(least), at(step)))


def perspective_corridor(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, vx, vy, lx, rx, score): the vanishing point whose edges to two feet on the lowest row follow strong
    gradients best, if it lies high enough, spans enough of the row, both edges are strong and the field between is dark.

    Points and feet stand on grids that are shares of the frame, so an image has a bounded number of candidates; what the
    best one lacks is not sought in others.
    """
    rows = K.stored(stencils.gradient_magnitude(with_oklab(pixels), "L", "gradient").select(*PIXEL, "L", "gradient"))
    spots = frames.select("image_id", "width", "height", F.explode(_grid(0.42, 0.63, "height", 0.025, 2)).alias("vy")).withColumn("vx", F.explode(_grid(0.38, 0.63, "width", 0.025, 4)))
    feet = F.concat(_grid(0.02, 0.39, "width", 0.035, 5), _grid(0.61, 0.99, "width", 0.035, 5))
    lines = spots.withColumn("foot", F.explode(feet)).withColumn("line", F.struct("vx", "vy", "foot"))
    lines = lines.select("image_id", "line", F.col("vx").alias("x0"), F.col("vy").alias("y0"), F.col("foot").alias("x1"), (F.col("height") - 1).alias("y1"))
    power = K.stored(joins.along(lines, rows, "gradient").select("image_id", "line.vx", "line.vy", "line.foot", "mean").join(frames, "image_id"))
    left, right = power.where("foot < width * 0.5").withColumnsRenamed({"foot": "lx", "mean": "l"}), power.where("foot > width * 0.5").select("image_id", "vx", "vy", F.col("foot").alias("rx"), F.col("mean").alias("r"))
    pairs = left.join(right, ["image_id", "vx", "vy"])
    score = F.sqrt(F.greatest(F.lit(0.0), F.col("l") * F.col("r"))) * (scalars.symmetry(F.col("vx") - F.col("lx"), F.col("rx") - F.col("vx")) * 0.22 + 0.78) * scalars.centre_prior(F.col("vx"), F.col("width"))
    order = F.struct(score.alias("score"), "l", "r", "vx", "vy", "lx", "rx")
    best = pairs.groupBy("image_id", "width", "height").agg(F.max(order).alias("b")).select("image_id", "width", "height", "b.*")
    best = K.stored(best.where("vy <= height * 0.56 and rx - lx >= width * 0.72 and least(l, r) >= 0.015").select("image_id", "vx", "vy", "lx", "rx", "score"))
    inset = F.greatest(F.lit(2), F.rint(F.col("width") * 0.035).cast("int"))
    core = corridor_mask(best, frames).join(frames, "image_id").where((F.col("x") >= inset) & (F.col("x") < F.col("width") - inset))
    dark = core.join(rows.hint("merge"), PIXEL).groupBy("image_id").agg(F.median("L").alias("light")).where("light < 0.42")
    return best.join(dark.select("image_id"), "image_id", "left_semi")


def corridor_mask(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows below the vanishing point, widening toward the two feet on the lowest row."""
    rows = found.join(frames, "image_id").withColumn("y", F.explode(F.sequence("vy", F.col("height") - 1)))
    t = F.pow((F.col("y") - F.col("vy")) / F.greatest(F.lit(1), F.col("height") - 1 - F.col("vy")), F.lit(0.88))
    half = F.greatest(F.lit(3), F.rint(F.col("width") * 0.018).cast("int"))
    edge = lambda begin, end: F.rint(begin + (F.col(end) - begin) * t).cast("int")
    low, high = F.greatest(F.lit(0), edge(F.col("vx") - half, "lx")), F.least(F.col("width") - 1, edge(F.col("vx") + half, "rx"))
    return rows.where(low <= high).select("image_id", "y", F.explode(F.sequence(low, high)).alias("x"))


def silhouette(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels of the most salient component that is darker than its rows' surroundings: neither too small nor too large, about
    the middle rows. A subject that runs on into its reflection is cut below the horizon, see tapered."""
    rows = with_oklab(pixels)
    radius = F.greatest(F.lit(4), F.rint(F.count("*") * 0.12).cast("int"))
    gap = K.stored(rows.join(stencils.reflected_mean(rows, "L", radius, "around").hint("merge"), PIXEL).withColumn("gap", F.col("around") - F.col("L")).select(*PIXEL, "L", "bb", "gap").join(frames, "image_id"))
    row = lambda share: F.rint(F.col("height") * share)
    limit = gap.where((F.col("y") >= row(0.28)) & (F.col("y") < row(0.90))).groupBy("image_id").agg(F.greatest(F.lit(0.045), F.percentile("gap", F.lit(0.88))).alias("limit"))
    strong = gap.join(limit.hint("merge"), "image_id").where((F.col("gap") > F.col("limit")) & (F.col("y") >= row(0.28)) & (F.col("y") < row(0.92))).select(PIXEL)
    parts = K.stored(K.components(stencils.closed(strong, 7, frames)))
    size = K.measures(parts).join(frames, "image_id").withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1)
    size = size.where("area between width * height * 0.003 and width * height * 0.15 and w between width * 0.04 and width * 0.38 and h between height * 0.10 and height * 0.55 and y0 < height * 0.68 and y1 > height * 0.48")
    power = parts.join(gap.select(*PIXEL, "gap").hint("merge"), PIXEL).groupBy("image_id", "component").agg(F.avg("gap").alias("gap")).join(size.hint("merge"), ["image_id", "component"])
    best = aggregates.best(power.withColumn("score", F.col("gap") * F.sqrt("area") * F.col("h") / F.col("height")), ["image_id"], "score", "component", ["component", "score", "x0", "x1", "y1"]).where("score >= 2.0")
    best = K.stored(best)
    subject = tapered(K.stored(parts.join(best.hint("merge"), ["image_id", "component"], "left_semi").select(PIXEL)), best, gap, frames)
    clearance = F.greatest(F.lit(1), F.rint(F.least("width", "height") * 0.040).cast("int"))
    return stencils.smoothed_boundary(K.filled(K.stored(subject), frames, clearance * clearance), 1.2, frames)


def tapered(subject: DataFrame, boxes: DataFrame, pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """A subject without its reflection. The horizon is the row where tint and lightness to the right of the subject change
    most; a subject that reaches far below it ends a little lower, narrowing to a trunk about its dark middle.

    boxes (image_id, x1, y1) of the subject; pixels with L and bb. Images without room to the right stay as they are.
    """
    right = F.least(F.col("width") - 2, F.col("x1") + F.greatest(F.lit(3), F.rint(F.col("width") * 0.05).cast("int")))
    beside = pixels.drop("width", "height").join(boxes.join(frames, "image_id").withColumn("right", right), "image_id").where((F.col("x") >= F.col("right")) & (F.col("width") - F.col("right") >= F.greatest(F.lit(8.0), F.rint(F.col("width") * 0.12))))
    lines = beside.groupBy("image_id", "height", "y").agg(F.median("bb").alias("tint"), F.median("L").alias("light")).withColumn("x", F.lit(0))
    change = F.abs(stencils.central_gradient("tint", "y")) + F.abs(stencils.central_gradient("light", "y")) * 0.5
    lines = lines.withColumn("change", change).where((F.col("y") >= F.rint(F.col("height") * 0.50)) & (F.col("y") < F.rint(F.col("height") * 0.72)))
    horizon = aggregates.best(lines, ["image_id"], "change", "y", ["y"]).withColumnRenamed("y", "horizon").join(frames, "image_id").join(boxes.select("image_id", "y1"), "image_id")
    horizon = horizon.withColumn("bottom", F.least(F.col("height") - 1, F.col("horizon") + F.rint(F.col("height") * 0.09).cast("int"))).where("y1 - bottom > height * 0.10")
    lower = K.stored(subject.join(horizon.hint("merge"), "image_id").where(F.col("y") >= F.col("horizon") - F.rint(F.col("height") * 0.03)).join(pixels.select(*PIXEL, "L").hint("merge"), PIXEL))
    dark = lower.join(lower.groupBy("image_id").agg(F.percentile("L", F.lit(0.45)).alias("limit")).hint("merge"), "image_id").where("L <= limit")
    trunk = horizon.join(dark.groupBy("image_id").agg(F.rint(F.median("x")).alias("middle")).hint("merge"), "image_id").select("image_id", "horizon", "bottom", "middle", "width")
    rows = subject.join(trunk.hint("merge"), "image_id", "left")
    t = (F.col("y") - F.col("horizon")) / F.greatest(F.lit(1), F.col("bottom") - F.col("horizon"))
    half = F.rint(F.col("width") * (F.lit(0.12) * (F.lit(1.0) - t) + t * 0.03))
    keep = F.col("horizon").isNull() | (F.col("y") < F.col("horizon")) | ((F.col("y") <= F.col("bottom")) & (F.abs(F.col("x") - F.col("middle")) <= half))
    return rows.where(keep).select(PIXEL)


def cool_shore(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """A cool field below the horizon that enters from the right and reaches down, where the lower left is warm and the middle
    right is cool; the largest one of an image, its boundary smoothed and its holes filled."""
    rows = K.stored(with_oklab(pixels).join(frames, "image_id").select(*PIXEL, "bb", "width", "height"))
    at = lambda size, share: F.rint(F.col(size) * share)
    near = (F.col("y") >= at("height", 0.65)) & (F.col("x") < at("width", 0.45))
    far = F.col("x") >= at("width", 0.55)
    middle = far & (F.col("y") >= at("height", 0.43)) & (F.col("y") < at("height", 0.64))
    tint = rows.groupBy("image_id").agg(F.median(F.when(near, F.col("bb"))).alias("warm"), F.median(F.when(middle, F.col("bb"))).alias("cool")).where("warm > 0.015 and cool < 0 and warm - cool > 0.035")
    lines = rows.where(far).groupBy("image_id", "height", "y").agg(F.median("bb").alias("tint")).withColumn("x", F.lit(0))
    lines = lines.withColumn("change", F.abs(stencils.central_gradient("tint", "y"))).where((F.col("y") >= at("height", 0.35)) & (F.col("y") < at("height", 0.58)))
    horizon = aggregates.best(lines, ["image_id"], "change", "y", ["y"]).withColumnRenamed("y", "horizon")
    cold = rows.join(tint.join(horizon.hint("merge"), "image_id").hint("merge"), "image_id").where((F.col("y") >= F.col("horizon")) & (F.col("bb") < (F.col("warm") + F.col("cool")) * 0.5)).select(PIXEL)
    parts = K.stored(K.components(stencils.closed(cold, 9, frames)))
    good = K.measures(parts).join(frames, "image_id").where("area >= width * height * 0.04 and x1 >= width - 3 and x1 - x0 >= width * 0.45 and y1 >= height * 0.85")
    best = aggregates.best(good, ["image_id"], "area", "component", ["component"])
    return K.filled(K.stored(stencils.smoothed_boundary(parts.join(best.hint("merge"), ["image_id", "component"], "left_semi"), 1.2, frames)), frames)


def compact_island(labelled: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, component, kind, score) of at most one focal island an image: compact, in contrast with a pure ring."""
    return _compact(labelled, frames)[0]


def _compact(labelled: DataFrame, frames: DataFrame, protected: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """compact_island and the pixels of its islands, grown into what differs from their rings as they do.

    Local contrast is a slight blur's distance from a broad one, both by the frame's size. An island keeps off the frame's edges
    and lies on protected labels by at most 30 %. The ring around it, without the three pixels next to it, must be of one label,
    even, and far in colour.
    """
    keys = ["image_id", "component"]
    side = frames.select("image_id", "width", "height")
    rows = labelled.select(*PIXEL, "label", "r", "g", "b").join(side, "image_id")
    fine = soft_oklab(rows, F.greatest(F.lit(1.0), F.greatest("width", "height") / 260.0))
    fine = fine.join(soft_oklab(rows, F.greatest(F.lit(6.0), F.greatest("width", "height") / 42.0), "s_").hint("merge"), PIXEL)
    gap = color.oklab_distance([F.col(c) for c in _LAB], [F.col(f"s_{c}") for c in _LAB])
    rows = K.stored(fine.withColumn("gap", gap).select(*PIXEL, *_LAB, *"rgb", "gap").join(labelled.select(*PIXEL, "label").hint("merge"), PIXEL))
    seeds = _inside(masks.above_percentile(rows, "gap", 0.982, 0.085), side)
    parts = K.stored(K.components(stencils.cleaned(seeds, 5, 5, side)))
    size = K.measures(parts).join(side, "image_id").withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1)
    size = size.where("area between width * height * 0.0008 and width * height * 0.025").where(_FREE)
    size = size.where((scalars.compactness(F.col("area"), F.col("w"), F.col("h")) >= 0.18) & (scalars.aspect(F.col("w"), F.col("h")) >= 0.20))
    parts = K.stored(parts.join(size.select(*keys).hint("merge"), keys, "left_semi"))
    own = parts.join(rows.hint("merge"), PIXEL)
    claimed = own.groupBy(*keys).agg(F.avg(F.when(F.col("label").isin(protected or []), 1.0).otherwise(0.0)).alias("claimed")).where("claimed <= 0.30").select(*keys)
    ring = K.stored(_ring(parts, side).join(rows.hint("merge"), PIXEL))
    pure = aggregates.purity(ring, "label", keys).where("purity >= 0.82").select(*keys)
    even = aggregates.spread(ring, keys, _LAB).where("spread <= 0.065").select(*keys)
    mid = lambda df, p: df.groupBy(*keys).agg(*(F.median(c).alias(f"{p}{c}") for c in (*_LAB, *"rgb")))
    outer = K.stored(mid(ring, "o"))
    both = mid(own, "i").join(outer, keys)
    for gate in (claimed, pure, even, size.select(*keys, "area", "w", "h", "width", "height")):
        both = both.join(gate, keys)
    contrast = color.weighted_distance([F.rint(f"i{c}") for c in "rgb"], [F.rint(f"o{c}") for c in "rgb"])
    share = F.sqrt(F.col("area") / (F.col("width") * F.col("height")))
    both = both.withColumn("contrast", _gap("i", "o")).withColumn("seen", contrast).where("seen >= 0.095").withColumn("score", F.col("seen") * share * scalars.compactness(F.col("area"), F.col("w"), F.col("h")))
    best = K.stored(aggregates.best(both, ["image_id"], "score", "component", ["component", "score", "contrast"]))
    core = K.stored(parts.join(best.hint("merge"), keys, "left_semi").select(PIXEL))
    far = rows.join(best.join(outer.select(*keys, *(f"o{c}" for c in _LAB)), keys), "image_id").where(_gap("", "o") >= F.greatest(F.lit(0.045), F.col("contrast") * 0.33)).select(PIXEL)
    whole = K.grown(core, masks.intersection(far, stencils.dilated(core, 13, side)), side)
    whole = K.stored(masks.union(stencils.cleaned(whole, 5, 3, side), core))
    return best.select("image_id", "component", "score", F.lit("local-contrast").alias("kind")), K.filled(whole, side)


#: An island's box: bounded, and off the frame's edges.
_FREE = "w <= width * 0.34 and h <= height * 0.30 and x0 > 2 and y0 > 2 and x1 < width - 3 and y1 < height - 3"


def _inside(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """A mask without the two pixels along the frame's edges."""
    return mask.join(frames.select("image_id", "width", "height"), "image_id").where("x >= 2 and y >= 2 and x < width - 2 and y < height - 2").select(PIXEL)


def _ring(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """(pixel, component): the surroundings of components, 3.5 % of the frame wide in all and 7 pixels at least, without the
    band of three next to them."""
    wide = F.greatest(F.lit(7), F.rint(F.least("width", "height") * 0.035).cast("int"))
    rows = parts.select(*PIXEL, "component").join(frames, "image_id").withColumn("_k", F.floor((wide + F.when(wide % 2 == 0, 1).otherwise(0)) / 2).cast("int"))
    across = rows.select("image_id", "component", "y", "height", "_k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - F.col("_k")), F.least(F.col("width").cast("int") - 1, F.col("x") + F.col("_k")))).alias("x")).distinct()
    around = across.select("image_id", "component", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - F.col("_k")), F.least(F.col("height").cast("int") - 1, F.col("y") + F.col("_k")))).alias("y"), "x").distinct()
    return around.join(joins.dilated_by(parts, "component", 3, frames).hint("merge"), [*PIXEL, "component"], "left_anti")


def soft_oklab(pixels: DataFrame, radius: float | Column, prefix: str = "") -> DataFrame:
    """(pixel, L, a, bb, and r, g, b as bytes) of the blurred image, names prefixed; the radius may be a column of width and
    height."""
    rows = pixels
    if isinstance(radius, Column):
        soft = pixels.select(PIXEL)
        for c in "rgb":
            soft = soft.join(stencils.blurred(rows, c, radius).hint("merge"), PIXEL)
    else:
        for c in "rgb":
            rows = stencils.gaussian(rows.withColumn(c, F.col(c).cast("double")), c, radius)
        soft = rows
    lab = color.oklab(*(F.rint(c) for c in "rgb"))
    return soft.select(*PIXEL, *(c.alias(prefix + n) for c, n in zip(lab, _LAB, strict=True)), *(F.rint(c).alias(prefix + c) for c in "rgb"))


# Least contrast, chroma and lightness above the surroundings of a line, and of fragments that extend it; top of
# the rows that both may lie in, as a share of the height.
_LINE, _FRAGMENT, _LINE_TOP = (0.055, 0.035, 0.018), (0.035, 0.025, 0.005), (0.52, 0.48)


def accent_line(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, component, slope, intercept, y0, y1, half): a thin chromatic line that rises from the bottom edge near the
    middle and aims at the central part; y0 is where it ends, half its half width at the bottom.

    A line is a component narrow, tall and straight enough, by the medians of its rows. Weaker evidence within a tube about
    it, in runs of at least three rows above it, extends it.
    """
    rows = pixels.select(*PIXEL, "r", "g", "b").join(frames.select("image_id", "width", "height"), "image_id")
    broad = soft_oklab(rows, F.greatest(F.lit(6.0), F.greatest("width", "height") / 45.0), "s_")
    fine = soft_oklab(rows, 0.7).join(broad.hint("merge"), PIXEL)
    lab = [F.col(c) for c in _LAB]
    cues = {"gap": color.oklab_distance(lab, [F.col(f"s_{c}") for c in _LAB]), "chroma": color.chroma(lab), "lift": F.col("L") - F.col("s_L")}
    fine = K.stored(fine.select(*PIXEL, *(v.alias(k) for k, v in cues.items())))
    above = lambda least: (F.col("gap") > least[0]) & (F.col("chroma") > least[1]) & (F.col("lift") > least[2])
    found = masks.zone(fine.where(above(_LINE)).select(PIXEL), frames, x=(0.30, 0.70), y=(_LINE_TOP[0], 1.0))
    keys = ["image_id", "component"]
    size = K.stored(K.components(stencils.closed(found, 3, frames)))
    parts, size = size, K.measures(size).join(frames, "image_id").withColumn("h", F.col("y1") - F.col("y0") + 1).withColumn("w", F.col("x1") - F.col("x0") + 1)
    size = K.stored(size.where("y1 >= height - 3 and h >= height * 0.18 and w <= width * 0.07 and h >= 4 * w").select(*keys, "h", "y0", "width", "height"))
    own = K.stored(parts.join(size.hint("merge"), keys).join(fine.hint("merge"), PIXEL))
    foot = own.where("y >= height - 12").groupBy(*keys, "width").agg(F.median("x").alias("foot")).where("foot between width * 0.35 and width * 0.65").select(*keys)
    lines = K.stored(own.groupBy(*keys, "height", "y").agg(F.median("x").alias("cx"), (F.max("x") - F.min("x") + 1).alias("across")))
    fit = aggregates.line_fit(lines, keys, "y", "cx").join(size, keys)
    top = F.col("slope") * F.rint(F.col("height") * _LINE_TOP[1]) + F.col("intercept")
    fit = fit.where((F.abs("slope") <= 0.5) & (F.col("error") <= F.greatest(F.lit(1.6), F.col("width") * 0.008)) & top.between(F.col("width") * 0.25, F.col("width") * 0.75))
    strength = own.groupBy(*keys).agg((F.avg("gap") * F.avg("chroma")).alias("strength"))
    fit = fit.join(foot, keys).join(strength, keys).withColumn("score", F.col("h") * F.col("strength"))
    best = K.stored(aggregates.best(fit, ["image_id"], "score", "component", ["component", "slope", "intercept", "y0"]).join(frames.select("image_id", "width", "height"), "image_id"))
    return best.join(_extended(fine.where(above(_FRAGMENT)), best), "image_id", "left").join(_half_width(lines, best), "image_id").select(*keys, "slope", "intercept", F.coalesce("top", "y0").cast("int").alias("y0"), (F.col("height") - 1).cast("int").alias("y1"), "half")


def _extended(weak: DataFrame, best: DataFrame) -> DataFrame:
    """(image_id, top): the first row of the runs of at least three rows above a line that have weak evidence in its tube."""
    reach = F.greatest(F.lit(3), F.rint(F.col("width") * 0.012))
    near = weak.join(best.hint("merge"), "image_id").where((F.col("y") >= F.rint(F.col("height") * _LINE_TOP[1])) & (F.col("y") < F.col("y0")))
    rows = near.where(F.abs(F.col("x") - F.rint(F.col("slope") * F.col("y") + F.col("intercept"))) <= reach).select("image_id", "y").distinct()
    rows = rows.withColumn("_run", F.col("y") - F.row_number().over(Window.partitionBy("image_id").orderBy("y")))
    return rows.groupBy("image_id", "_run").agg(F.count("*").alias("n"), F.min("y").alias("y")).where("n >= 3").groupBy("image_id").agg(F.min("y").alias("top"))


def _half_width(lines: DataFrame, best: DataFrame) -> DataFrame:
    """(image_id, half) of a line's lowest 20 rows, or of all its rows if none of them is so low."""
    own = lines.join(best.select("image_id", "component").hint("merge"), ["image_id", "component"])
    low = F.coalesce(F.median(F.when(F.col("y") >= F.col("height") - 20, F.col("across"))), F.median("across"))
    return own.groupBy("image_id").agg(F.greatest(F.lit(1.3), low * 0.32).alias("half"))


def ribbon(lines: DataFrame, frames: DataFrame, top: float = 0.55) -> DataFrame:
    """Pixels of a line that widens from half a pixel to either side at its top to its half width at the bottom."""
    rows = lines.join(frames, "image_id").withColumn("y", F.explode(F.sequence("y0", "y1")))
    t = (F.col("y") - F.col("y0")) / F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    mid, half = F.col("slope") * F.col("y") + F.col("intercept"), F.pow(t, F.lit(1.25)) * (F.col("half") - top) + top
    low, high = F.greatest(F.lit(0), F.floor(mid - half).cast("int")), F.least(F.col("width").cast("int") - 1, F.ceil(mid + half).cast("int"))
    return rows.withColumns({"_l": low, "_h": high}).where("_l <= _h").select("image_id", "y", F.explode(F.sequence("_l", "_h")).alias("x"))


def luminous_support(pixels: DataFrame, frames: DataFrame, focal: DataFrame) -> DataFrame:
    """Pixels of a broad area that is lighter than one side of its rows, reaches the frame and lies about a focal mask.

    Each side of the frame is a reference of its own: the components that stand out against the left or the right part of
    their rows are candidates beside each other, each is closed, filled and smoothed alone, and the one with most pixels near
    the focal mask for its size is taken; of equal ones that of the left side.
    """
    frames = frames.select("image_id", "width", "height")
    seen = focal.groupBy("image_id").agg(F.min("y").alias("_a"), F.max("y").alias("_b")).join(frames, "image_id")
    first, last = F.greatest(F.lit(2), F.col("_a") - F.rint(F.col("height") * 0.20)), F.least(F.col("height") - 2, F.col("_b") + F.rint(F.col("height") * 0.42))
    seen = K.stored(seen.select("image_id", "width", "height", first.alias("first"), last.alias("last")))
    rows = pixels.select(*PIXEL, "r", "g", "b").join(seen.select("image_id"), "image_id", "left_semi")
    soft = K.stored(soft_oklab(rows, 2.0).join(seen.hint("merge"), "image_id"))
    left, right = F.col("x") < F.greatest(F.lit(3), F.rint(F.col("width") * 0.22)), F.col("x") >= F.least(F.col("width") - 3, F.rint(F.col("width") * 0.78))
    sides = soft.groupBy("image_id", "y").agg(*(F.median(F.when(c, F.col("L"))).alias(f"_{i}") for i, c in enumerate((left, right))))
    light = soft.where("y >= first and y < last").join(sides.hint("merge"), ["image_id", "y"]).select("image_id", "y", "x", "L", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_{i}").alias("ref")) for i in (0, 1)))).alias("s"))
    sheets = K.stored(seen.select(F.explode(F.array(F.col("image_id") * 2, F.col("image_id") * 2 + 1)).alias("image_id"), "width", "height"))
    light = light.where(F.col("L") - F.col("s.ref") >= 0.050).select((F.col("image_id") * 2 + F.col("s.i")).alias("image_id"), "y", "x")
    parts = K.stored(K.components(stencils.cleaned(K.stored(stencils.closed(light, 9, sheets, shrink=7)), 1, 5, sheets)))
    total = F.col("width") * F.col("height")
    size = K.measures(parts).join(sheets, "image_id").where(F.col("area").between(total * 0.045, total * 0.32)).where("x1 - x0 + 1 >= width * 0.35 and y1 - y0 + 1 >= height * 0.12 and (x0 <= 2 or x1 >= width - 3)")
    reach = F.greatest(F.lit(7), F.rint(F.least("width", "height") * 0.040).cast("int"))
    near = stencils.dilated(focal.select(PIXEL), reach + F.when(reach % 2 == 0, 1).otherwise(0), frames)
    near = near.select(F.explode(F.array(F.col("image_id") * 2, F.col("image_id") * 2 + 1)).alias("image_id"), "y", "x")
    keys = ["image_id", "component"]
    touch = parts.join(near.hint("merge"), PIXEL, "left_semi").groupBy(*keys).agg(F.count("*").alias("adjacent"))
    chosen = size.join(touch, keys).where(F.col("adjacent") >= F.greatest(F.lit(8.0), F.rint(total * 0.001)))
    image = F.floor(F.col("image_id") / 2).cast("long")
    turn = F.row_number().over(Window.partitionBy(image).orderBy("image_id", "component"))
    chosen = K.stored(chosen.select(*keys, image.alias("image"), (image * 64 + turn).alias("sheet"), "width", "height", "adjacent"))  # under 64, as each covers 4.5 % of a side's reference
    alone = chosen.select(F.col("sheet").alias("image_id"), "width", "height")
    own = parts.join(chosen.select(*keys, "sheet"), keys).select(F.col("sheet").alias("image_id"), "y", "x")
    own = K.stored(stencils.gap_closed(own, scalars.gap_kernel(F.col("width"), F.col("height"), 0.022), alone).select(PIXEL))
    radius = F.greatest(F.lit(1.0), F.least("width", "height") * 0.0035)
    own = K.stored(stencils.smoothed_boundary(K.stored(K.filled(own, alone)), radius, alone))
    score = own.groupBy(F.col("image_id").alias("sheet")).agg(F.count("*").alias("n")).join(chosen, "sheet").select(F.col("image").alias("image_id"), "sheet", (F.col("adjacent") * F.sqrt(F.col("n") / total)).alias("score"))
    best = aggregates.best(score, ["image_id"], "score", "sheet", ["sheet"])
    return own.withColumnRenamed("image_id", "sheet").join(best, "sheet").select(PIXEL)


# Bounds of the two weaker kinds of focal island, as shares of the frame or distances in Oklab.
_RARE = {"low": 0.030, "high": 0.055, "calm": 0.035, "area": (0.001, 0.025), "compact": 0.25, "aspect": 0.18, "purity": 0.80, "strength": 0.82, "spread": 0.035, "ring": 0.016, "cap": (0.00015, 0.004), "gap": 0.045, "agree": 0.82}
_CROSS = {"top": 0.82, "share": 0.10, "cover": 0.88, "distance": 0.075, "area": (0.0007, 0.022), "compact": 0.25, "aspect": 0.16, "lowest": 0.80, "spread": 0.10, "rarity": 0.045}


def _boxes(parts: DataFrame, frames: DataFrame, area: tuple[float, float], compact: float, aspect: float) -> DataFrame:
    size = K.measures(parts).join(frames, "image_id").withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1)
    total = F.col("width") * F.col("height")
    return size.where(F.col("area").between(total * area[0], total * area[1]) & (scalars.compactness(F.col("area"), F.col("w"), F.col("h")) >= compact) & (scalars.aspect(F.col("w"), F.col("h")) >= aspect))


def _medians(rows: DataFrame, keys: list[str], prefix: str, columns: list[str] = _LAB) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.median(c).alias(f"{prefix}{c}") for c in columns))


def _gap(one: str, two: str):
    return color.oklab_distance([F.col(f"{one}{c}") for c in _LAB], [F.col(f"{two}{c}") for c in _LAB])


def rare_chromatic_island(labelled: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, component, kind, score, satellites): a small patch whose hue is rare in an otherwise calm image, and the
    patches above it that share its hue."""
    return _rare(labelled, frames)[0]


def _rare(labelled: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rare_chromatic_island and the pixels of its patches with their satellites and the bridges between them.

    Hue is rare by its distance from the median hue of the image; an image whose hues lie neither near nor far enough has no
    island. A patch that one label represents already is none. A satellite is small, lies above with overlapping columns, and
    departs from the median hue in the same direction.
    """
    t, keys, hue = _RARE, ["image_id", "component"], ["a", "bb"]
    side = frames.select("image_id", "width", "height")
    rows = soft_oklab(labelled.select(*PIXEL, "r", "g", "b").join(side, "image_id"), F.greatest(F.lit(1.0), F.greatest("width", "height") / 260.0))
    mid = rows.groupBy("image_id").agg(*(F.median(c).alias(f"m{c}") for c in hue))
    away = lambda p, q: F.sqrt(sum(((F.col(f"{p}{c}") - F.col(f"{q}{c}")) * (F.col(f"{p}{c}") - F.col(f"{q}{c}")) for c in hue), F.lit(0.0)))
    rows = K.stored(rows.join(mid.hint("merge"), "image_id").withColumn("gap", away("", "m")).select(*PIXEL, *hue, "gap").join(labelled.select(*PIXEL, "label").hint("merge"), PIXEL))
    lim = rows.groupBy("image_id").agg(F.percentile("gap", F.lit(0.982)).alias("p98"), F.percentile("gap", F.lit(0.90)).alias("p90")).where(F.col("p98").between(t["low"], t["high"]) & (F.col("p90") <= t["calm"]))
    lim = K.stored(lim.join(mid.hint("merge"), "image_id").join(side, "image_id"))
    seeds = _inside(rows.join(lim.select("image_id", "p98").hint("merge"), "image_id").where("gap >= p98"), side)
    parts = K.stored(K.components(stencils.cleaned(K.stored(stencils.closed(seeds, 7, side, shrink=5)), 1, 3, side)))
    boxes = K.stored(K.measures(parts).join(side, "image_id"))
    size = _boxes(parts, side, t["area"], t["compact"], t["aspect"]).where(_FREE).select(*keys, "area", "w", "h", "x0", "x1", "y0")
    hues = K.stored(_medians(parts.join(rows.hint("merge"), PIXEL), keys, "i", hue).join(lim.hint("merge"), "image_id"))
    own = parts.join(size.select(*keys).hint("merge"), keys, "left_semi").join(rows.hint("merge"), PIXEL)
    mixed = aggregates.purity(own, "label", keys).where(F.col("purity") < t["purity"]).select(*keys)
    even = aggregates.spread(own, keys, hue).where(F.col("spread") <= t["spread"]).select(*keys)
    around = _medians(_ring(parts.join(size.select(*keys).hint("merge"), keys, "left_semi"), side).join(rows.hint("merge"), PIXEL), keys, "o", hue)
    good = hues.where(away("i", "m") >= F.col("p98") * t["strength"])
    for gate in (around, mixed, even, size):
        good = good.join(gate, keys)
    good = good.withColumn("contrast", away("i", "o")).where(F.col("contrast") >= t["ring"])
    share = F.sqrt(F.col("area") / (F.col("width") * F.col("height")))
    good = good.withColumn("score", F.col("contrast") * share * scalars.compactness(F.col("area"), F.col("w"), F.col("h")))
    best = K.stored(aggregates.best(good, ["image_id"], "score", "component", ["component", "score", "w", "x0", "x1", "y0", "ia", "ibb", "ma", "mbb", "height"]))
    caps = boxes.where(F.col("area").between(F.col("width") * F.col("height") * t["cap"][0], F.col("width") * F.col("height") * t["cap"][1])).select(*keys).unionByName(best.select(*keys)).distinct()
    near = joins.satellites(boxes.join(caps, keys).select(*keys, "x0", "x1", "y0", "y1", "height"), F.col("m.height"), t["gap"]).join(best.select("image_id", F.col("component").alias("main"), "w", "x0", "x1", "y0", "ia", "ibb", "ma", "mbb"), ["image_id", "main"])
    other = hues.select("image_id", F.col("component").alias("satellite"), F.col("ia").alias("sa"), F.col("ibb").alias("sbb"))
    near = near.join(other, ["image_id", "satellite"])
    vector = lambda p: [F.lit(0.0), F.col(f"{p}a") - F.col("ma"), F.col(f"{p}bb") - F.col("mbb")]
    near = K.stored(near.where((away("i", "m") > 0) & (away("s", "m") > 0) & (color.hue_cosine(vector("s"), vector("i")) >= t["agree"])))
    named = near.groupBy("image_id").agg(F.array_sort(F.collect_set("satellite")).alias("satellites"))
    found = K.stored(best.join(named, "image_id", "left").select(*keys, F.lit("rare-chromatic").alias("kind"), "score", F.coalesce("satellites", F.array().cast("array<long>")).alias("satellites")))
    every = found.select("image_id", F.explode(F.array_union(F.array("component"), "satellites")).alias("component"))
    whole = parts.join(every.hint("merge"), keys, "left_semi").select(PIXEL).unionByName(_bridges(near, boxes, parts, side)).distinct()
    radius = F.greatest(F.lit(0.45), F.least("width", "height") * 0.0018)
    seen = side.join(found.select("image_id"), "image_id", "left_semi")
    return found, stencils.smoothed_boundary(K.stored(K.filled(K.stored(whole), seen)), radius, seen)


def _bridges(near: DataFrame, boxes: DataFrame, parts: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels between an island and each satellite (near: image_id, satellite, w, x0, x1, y0 of the island), about the median
    column of the satellite, as wide as 0.36 of the narrower of the two."""
    box = boxes.select("image_id", F.col("component").alias("satellite"), (F.col("x1") - F.col("x0") + 1).alias("_sw"), F.col("y1").alias("_sy"))
    centre = parts.join(near.select("image_id", F.col("satellite").alias("component")).hint("merge"), ["image_id", "component"], "left_semi").groupBy("image_id", F.col("component").alias("satellite")).agg(F.median("x").alias("_c"))
    rows = near.join(box, ["image_id", "satellite"]).join(centre, ["image_id", "satellite"]).join(frames.select("image_id", "width"), "image_id")
    mid = F.least(F.col("x1"), F.greatest(F.col("x0"), F.rint("_c").cast("int")))
    half = F.greatest(F.lit(1), F.rint(F.least("w", "_sw") * 0.18).cast("int"))
    rows = rows.where(F.col("_sy") + 1 < F.col("y0")).select("image_id", F.explode(F.sequence(F.col("_sy") + 1, F.col("y0") - 1)).alias("y"), F.greatest(F.lit(0), mid - half).alias("_l"), F.least(F.col("width").cast("int") - 1, mid + half).alias("_h"))
    return rows.where("_l <= _h").select("image_id", "y", F.explode(F.sequence("_l", "_h")).alias("x")).select(PIXEL)


def cross_field_island(labelled: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, component, kind, score): a patch at the meeting of two or three fields that has the colour of none."""
    return _cross(labelled, frames)[0]


def _cross(labelled: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cross_field_island and the pixels of its patches."""
    t, keys = _CROSS, ["image_id", "component"]
    rows = K.stored(labelled.select(*PIXEL, "label", *_LAB))
    roles = K.stored(_medians(rows, ["image_id", "label"], "r"))
    near = joins.nearest_centre_of_image(rows.drop("label"), _LAB, roles.select("image_id", "label", *(F.col(f"r{c}").alias(c) for c in _LAB)), "near").join(roles.withColumnRenamed("label", "near"), ["image_id", "near"])
    far = near.where(_gap("", "r") >= t["distance"]).select(PIXEL)
    parts = K.stored(K.components(stencils.closed(stencils.opened(far, 3, frames), 3, frames)))
    size = K.stored(_boxes(parts, frames, t["area"], t["compact"], t["aspect"]).where(F.col("cy") < F.col("height") * t["lowest"]))
    own = K.stored(parts.join(size.select(*keys).hint("merge"), keys, "left_semi").join(rows.hint("merge"), PIXEL))
    ring = joins.ring(own.select(*PIXEL, "component"), 9, frames).join(rows.hint("merge"), PIXEL)
    share = ring.groupBy(*keys, "label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    fields = K.stored(share.where(F.col("share") >= t["share"]))
    meets = fields.groupBy(*keys).agg(F.max("share").alias("top"), F.count("*").alias("k"), F.sum("share").alias("cover")).where((F.col("top") < t["top"]) & F.col("k").between(2, 3) & (F.col("cover") >= t["cover"])).select(*keys)
    mid = K.stored(_medians(own, keys, "i"))
    apart = fields.join(mid.hint("merge"), keys).join(roles, ["image_id", "label"]).groupBy(*keys).agg(F.min(_gap("i", "r")).alias("contrast")).where(F.col("contrast") >= t["distance"])
    even = aggregates.spread(own, keys, _LAB).where(F.col("spread") <= t["spread"]).select(*keys)
    rare = aggregates.rarity(rows, mid.select(*keys, *(F.col(f"i{c}").alias(c) for c in _LAB)), _LAB).where(F.col("rarity") <= t["rarity"]).select(*keys)
    good = meets.join(apart, keys).join(even, keys).join(rare, keys).join(size.select(*keys, "area", "w", "h"), keys)
    good = good.withColumn("score", F.col("contrast") * F.sqrt("area") * scalars.compactness(F.col("area"), F.col("w"), F.col("h")))
    found = K.stored(aggregates.best(good, ["image_id"], "score", "component", ["component", "score"]).select("image_id", "component", F.lit("cross-field").alias("kind"), "score"))
    return found, parts.join(found.hint("merge"), keys, "left_semi").select(PIXEL)


def focal_island(labelled: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, component, kind, score): at most one island an image, by local contrast before rare hue before junction."""
    return focal_masks(labelled, frames)[0]


def focal_masks(labelled: DataFrame, frames: DataFrame, protected: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """focal_island and the pixels of its islands. A weaker kind is sought only in images where no stronger one was found.
    protected: labels that an island of local contrast may lie on by 30 % at most."""
    names = ["image_id", "component", "kind", "score"]
    found, mask = _compact(labelled, frames, protected)
    found = K.stored(found.select(*names))
    for weaker in (_rare, _cross):
        rest = K.stored(frames.join(found, "image_id", "left_anti"))
        if K.without_rows(rest):
            break
        more, pixels = weaker(labelled.join(rest.select("image_id"), "image_id", "left_semi"), rest)
        found, mask = K.stored(found.unionByName(more.select(*names))), mask.unionByName(pixels)
    return found, mask
