"""Regions of a label raster: selection under a budget, merging of what was not selected, filling of negative space."""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators import components as K
from pixelloom.operators import joins, masks, stencils
from pixelloom.operators.masks import PIXEL

#: Area below which a protected region is dropped; terms of a region's score.
PROTECTED_SHARE, SCORE_BASE, SCORE_CONTRAST = 0.0007, 0.55, 1.8


def scored(parts: DataFrame, frames: DataFrame, palette: DataFrame, background: DataFrame, detail: float, protected: list[int] | None = None) -> DataFrame:
    """Components (image_id, component, label) of sufficient area with area, box, centre and score.

    palette (image_id, label, r, g, b); background (image_id, background).
    """
    size = K.measures(parts, "label").join(frames, "image_id").join(background, "image_id").where("label <> background")
    total = F.col("width") * F.col("height")
    least = F.when(F.col("label").isin(protected or []), total * PROTECTED_SHARE).otherwise(total * (0.014 - 0.010 * detail))
    own = palette.select("image_id", "label", "r", "g", "b")
    back = palette.select("image_id", F.col("label").alias("background"), *(F.col(c).alias(f"b{c}") for c in "rgb"))
    rows = size.where(F.col("area") >= least).join(own, ["image_id", "label"]).join(back, ["image_id", "background"])
    contrast = color.weighted_distance([F.col(c) for c in "rgb"], [F.col(f"b{c}") for c in "rgb"])
    return rows.withColumn("score", F.col("area") / total * (contrast * SCORE_CONTRAST + SCORE_BASE)).drop("r", "g", "b", "br", "bg", "bb", "width", "height")


def within_budget(regions: DataFrame, most: int, paint_last: list[int] | None = None) -> DataFrame:
    """The largest region of each label, then the best-scored others, at most `most` an image, with their paint order."""
    first = F.row_number().over(Window.partitionBy("image_id", "label").orderBy(F.desc("area"), "component")) == 1
    rows = regions.withColumn("mandatory", first)
    turn = Window.partitionBy("image_id").orderBy(F.desc("mandatory"), F.when(F.col("mandatory"), F.col("label")), F.desc("score"), "component")
    rows = rows.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= most).drop("_n")
    paint = Window.partitionBy("image_id").orderBy(F.col("label").isin(paint_last or []), "cy", F.desc("area"), "component")
    return rows.withColumn("paint", F.row_number().over(paint))


def merged_owners(dropped: DataFrame, owners: DataFrame, frames: DataFrame, dropped_color: DataFrame, owner_color: DataFrame, protected: list[int] | None = None) -> DataFrame:
    """(image_id, component, owner, contacts): the owner that each dropped component joins.

    dropped (pixel, component, label) and owners (pixel, owner); colours by component and by owner, the latter with label.
    All components choose at once, among the owners as they are before any merge. A component without contact looks at its
    surroundings. An owner with a protected label takes components of its own label only.
    """
    touch = K.stored(joins.contacts(dropped, owners))
    lonely = dropped.join(touch.select("image_id", "component").distinct(), ["image_id", "component"], "left_anti")
    found = touch.unionByName(joins.near_contacts(lonely, owners, frames))
    label = dropped.select("image_id", "component", "label").distinct()
    rows = found.join(label, ["image_id", "component"]).join(dropped_color, ["image_id", "component"])
    rows = rows.join(owner_color.select("image_id", "owner", F.col("label").alias("owner_label"), *(F.col(c).alias(f"o{c}") for c in "rgb")), ["image_id", "owner"])
    rows = rows.where(~F.col("owner_label").isin(protected or []) | (F.col("owner_label") == F.col("label")))
    gap = color.weighted_distance([F.col(c) for c in "rgb"], [F.col(f"o{c}") for c in "rgb"])
    return joins.best_owner(rows, gap).select("image_id", "component", "owner", "contacts")


def _in_order(protected: frozenset[int]):
    """Merges of one image: components in reading order, each with the owners as they are by then."""

    def kernel(edges: pd.DataFrame, inks: pd.DataFrame) -> pd.DataFrame:
        ink = {(k, n): (lab, rgb) for k, n, lab, *rgb in zip(*(inks[c].tolist() for c in ("is_owner", "node", "label", "r", "g", "b")), strict=True)}
        edges = edges.sort_values("component")
        belongs: dict[int, int] = {}
        rows = []
        for component, own in groupby(zip(*(edges[c].tolist() for c in ("component", "is_owner", "target", "contacts", "near")), strict=True), itemgetter(0)):
            label, color_of = ink[False, component]
            found: dict[int, list[int]] = {}
            for _, is_owner, target, side, near in own:
                owner = target if is_owner else belongs.get(target)
                if owner is not None:
                    sums = found.setdefault(owner, [0, 0])
                    sums[0] += side
                    sums[1] += near
            touched = {o: c for o, (c, _) in found.items() if c} or {o: n for o, (_, n) in found.items() if n}
            scores = []
            for owner, n in touched.items():
                owner_label, owner_ink = ink[True, owner]
                if owner_label not in protected or owner_label == label:
                    off = [(a - b) * w for a, b, w in zip(color_of, owner_ink, (0.30, 0.59, 0.11), strict=True)]
                    gap = math.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) / 255.0
                    scores.append((n / (1 + 2 * gap), n, -owner))
            if scores:
                _, n, owner = max(scores)
                belongs[component] = -owner
                rows.append((edges["image_id"].iloc[0], component, -owner, n))
        return pd.DataFrame(rows, columns=["image_id", "component", "owner", "contacts"])

    return kernel


def merged_in_order(dropped: DataFrame, owners: DataFrame, frames: DataFrame, dropped_color: DataFrame, owner_color: DataFrame, protected: list[int] | None = None) -> DataFrame:
    """(image_id, component, owner, contacts): like merged_owners, but one after the other in reading order of the components'
    first pixels, so that what was merged before counts as its owner's. `components` numbers them in that order.

    Contacts between components and owners, and of components with each other, are counted over all pixels by joins; a kernel
    then contracts the graph of one image, which has a row for each pair that touches. A component that touches no owner at its
    turn looks at owned pixels in the square of 7 around it. Components without any owner near are left out.
    """
    known = K.stored(dropped.select(*PIXEL, "component", "label"))
    targets = owners.select(*PIXEL, (F.col("owner") * 2 + 1).alias("owner")).unionByName(known.select(*PIXEL, (F.col("component") * 2).alias("owner")))
    targets = K.stored(targets)  # read and merged image by image, as are all pixels here
    others = F.col("owner") != F.col("component") * 2
    touch = K.stored(joins.contacts(known, targets).where(others))
    met = touch.where(F.col("owner") % 2 == 1).select("image_id", "component").distinct()
    lonely = K.stored(known.join(met.hint("merge"), ["image_id", "component"], "left_anti"))
    around = joins.dilated_by(lonely, "component", 7, frames)
    near = around.join(joins.by_image(targets), PIXEL).where(others).groupBy("image_id", "component", "owner").agg(F.count("*").alias("near"))
    edges = touch.select("image_id", "component", "owner", "contacts", F.lit(0).cast("long").alias("near")).unionByName(near.select("image_id", "component", "owner", F.lit(0).cast("long").alias("contacts"), "near"))
    edges = edges.groupBy("image_id", "component", "owner").agg(F.sum("contacts").alias("contacts"), F.sum("near").alias("near"))
    edges = edges.select("image_id", "component", (F.col("owner") % 2 == 1).alias("is_owner"), F.shiftright("owner", 1).alias("target"), "contacts", "near")
    ink = [F.col(c).cast("double").alias(c) for c in "rgb"]
    inks = dropped_color.join(known.select("image_id", "component", "label").distinct().hint("merge"), ["image_id", "component"]).select("image_id", F.lit(False).alias("is_owner"), F.col("component").alias("node"), "label", *ink)
    inks = inks.unionByName(owner_color.select("image_id", F.lit(True).alias("is_owner"), F.col("owner").cast("long").alias("node"), "label", *ink))
    return edges.groupBy("image_id").cogroup(inks.groupBy("image_id")).applyInPandas(lambda a, b: _in_order(frozenset(protected or ()))(a, b), "image_id long, component long, owner long, contacts long")


def merge_counts(merges: DataFrame, dropped: DataFrame, owners: DataFrame) -> DataFrame:
    """(image_id, owner, components, pixels) that each owner took in; owners that took nothing have zeros."""
    size = dropped.groupBy("image_id", "component").agg(F.count("*").alias("area"))
    took = merges.join(size.hint("merge"), ["image_id", "component"]).groupBy("image_id", "owner").agg(F.count("*").alias("components"), F.sum("area").alias("pixels"))
    return owners.select("image_id", "owner").distinct().join(took.hint("merge"), ["image_id", "owner"], "left").na.fill(0, ["components", "pixels"])


def negative_space(fields: DataFrame, frames: DataFrame, kernel: int | Column) -> DataFrame:
    """(pixel, owner): slivers between fields (pixel, owner) that are too narrow or small to stand, given to the field they
    touch most. Narrow means closed by the kernel, a number or a column of frames; small means a hole of at most kernel
    squared pixels."""
    return negative_space_parts(fields, frames, kernel)[0].select(*PIXEL, "owner")


def negative_space_parts(fields: DataFrame, frames: DataFrame, kernel: int | Column) -> tuple[DataFrame, DataFrame]:
    """negative_space with the component of each pixel; and (image_id, closed_pixels, holes_filled): pixels that the kernel
    closed, and small holes that were filled besides, of images that have any."""
    every = K.stored(masks.union(fields))
    wide = K.stored(stencils.gap_closed(every, kernel, frames).select(PIXEL))
    whole = K.stored(K.filled(wide, frames, kernel * kernel))
    added = K.stored(masks.difference(whole, every))
    parts = K.stored(K.components(added))
    touch = K.stored(joins.contacts(parts, fields))
    lonely = parts.join(touch.select("image_id", "component").distinct(), ["image_id", "component"], "left_anti")
    found = touch.unionByName(joins.near_contacts(lonely, fields, frames))
    w = Window.partitionBy("image_id", "component").orderBy(F.desc("contacts"), "owner")
    best = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("image_id", "component", "owner")
    closed = masks.difference(wide, every).groupBy("image_id").agg(F.count("*").alias("closed_pixels"))
    holes = K.components(K.stored(masks.difference(whole, wide))).groupBy("image_id").agg(F.count_distinct("component").alias("holes_filled"))
    totals = closed.join(holes, "image_id", "full").na.fill(0)
    return parts.join(best.hint("merge"), ["image_id", "component"]).select(*PIXEL, "owner", "component"), totals


def unclaimed_holes(field: DataFrame, others: DataFrame, background: DataFrame, frames: DataFrame, most_background: float = 0.5, inner: DataFrame | None = None) -> DataFrame:
    """Pixels of a field's holes that touch no other field and are mostly not background: they join the field. inner are the
    holes if they are known."""
    inner = K.stored(K.holes(field, frames)) if inner is None else inner
    reached = joins.contacts(inner, others.select(*PIXEL, F.lit(0).alias("owner"))).select("image_id", "component")
    covered = inner.join(others.select(PIXEL).hint("merge"), PIXEL, "left_semi").select("image_id", "component")
    back = inner.join(background.select(*PIXEL, F.lit(1).alias("_b")).hint("merge"), PIXEL, "left").groupBy("image_id", "component").agg(F.avg(F.coalesce("_b", F.lit(0))).alias("share"))
    keep = back.where(F.col("share") < most_background).join(reached.unionByName(covered).distinct(), ["image_id", "component"], "left_anti")
    return inner.join(keep.select("image_id", "component"), ["image_id", "component"], "left_semi").select(PIXEL)


def chromatic_false_background(holes: DataFrame, pixels: DataFrame, background: DataFrame, frames: DataFrame, field_color: DataFrame, back_color: DataFrame) -> DataFrame:
    """(image_id, component): holes that look like background by label but by hue belong to the enclosing field: small, mostly background-labelled,
    chromatic like the field and opposite to the background. Colours are (image_id, a, bb) in Oklab."""
    size = K.measures(holes).join(frames, "image_id")
    back = holes.join(background.select(*PIXEL, F.lit(1).alias("_b")).hint("merge"), PIXEL, "left").groupBy("image_id", "component").agg(F.avg(F.coalesce("_b", F.lit(0))).alias("share"))
    mid = holes.join(pixels.select(*PIXEL, "r", "g", "b").hint("merge"), PIXEL).groupBy("image_id", "component").agg(*(F.median(c).alias(c) for c in "rgb"))
    lab = color.oklab(F.col("r"), F.col("g"), F.col("b"))
    rows = size.join(back, ["image_id", "component"]).join(mid, ["image_id", "component"]).join(field_color.select("image_id", F.col("a").alias("fa"), F.col("bb").alias("fb")), "image_id").join(back_color.select("image_id", F.col("a").alias("ba"), F.col("bb").alias("bk")), "image_id")
    own, field, ground = [F.lit(0.0), *lab[1:]], [F.lit(0.0), F.col("fa"), F.col("fb")], [F.lit(0.0), F.col("ba"), F.col("bk")]
    small = (F.col("area") <= F.col("width") * F.col("height") * 0.002) & (F.col("x1") - F.col("x0") + 1 <= F.col("width") * 0.07) & (F.col("y1") - F.col("y0") + 1 <= F.col("height") * 0.07)
    strong = (color.chroma(own) >= 0.055) & (color.chroma(field) >= 0.055) & (color.chroma(ground) >= 0.040)
    hue = (color.hue_cosine(own, field) >= 0.80) & (color.hue_cosine(own, ground) <= -0.45)
    return rows.where((F.col("share") >= 0.80) & small & strong & hue).select("image_id", "component")


def bled(mask: DataFrame, frames: DataFrame, margin: int | Column) -> DataFrame:
    """A mask continued beyond the frame's edges that it touches, by margin pixels and into the corners; the margin may be a
    column of frames."""
    rows = mask.select(PIXEL).join(frames, "image_id").withColumn("_m", margin if isinstance(margin, Column) else F.lit(margin))
    far = lambda c, sign: F.col(c) + F.col("_m") * sign
    spread = lambda at_low, at_high, c: F.explode(F.when(at_low & at_high, F.sequence(far(c, -1), far(c, 1))).when(at_low, F.sequence(far(c, -1), F.col(c))).when(at_high, F.sequence(F.col(c), far(c, 1))).otherwise(F.array(F.col(c)))).alias(c)
    rows = rows.select("image_id", "y", "height", "_m", spread(F.col("x") == 0, F.col("x") == F.col("width") - 1, "x"))
    return rows.select("image_id", "x", spread(F.col("y") == 0, F.col("y") == F.col("height") - 1, "y")).select(PIXEL).distinct()


def boundary_edges(parts: DataFrame, key: str = "component") -> DataFrame:
    """(image_id, key, ax, ay, bx, by): unit edges of each part's outline, clockwise: four anti-joins on shifted pixels."""
    sides = ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0)))
    side = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((dy, dx, *e), ("dy", "dx", "ax", "ay", "bx", "by"), strict=True))) for dy, dx, e in sides))).alias("s")
    rows = parts.select("image_id", key, "y", "x", side).select("image_id", key, (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), *((F.col(p) + F.col(f"s.{c}")).alias(c) for c, p in (("ax", "x"), ("ay", "y"), ("bx", "x"), ("by", "y"))))
    inside = parts.select("image_id", key, F.col("y").alias("ny"), F.col("x").alias("nx"))
    return rows.join(inside.hint("merge"), ["image_id", key, "ny", "nx"], "left_anti").select("image_id", key, "ax", "ay", "bx", "by")
