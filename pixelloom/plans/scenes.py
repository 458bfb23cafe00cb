"""Three ways to compose an image: colour fields of a palette, night landscapes, and landscapes that mirror in water.

Each takes the images of its kind at once and gives a Scene, so that outlines, gradients and documents are drawn alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import aggregates, detect, joins, masks, palette, regions, stencils
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL
from pixelloom.plans.options import Options

#: Labels of what is marked beside the palette; support, island and accent stand for at most one feature an image each.
SPATIAL, SUPPORT, ISLAND, ACCENT = 100, 110, 111, 112
PROTECTED = [SPATIAL, SPATIAL + 1, SPATIAL + 2, SUPPORT, ISLAND, ACCENT]
#: Fixed value: least confidence of all quadrants at which labels by colour alone stand.
SURE = 0.56
_LAB = ["L", "a", "bb"]


@dataclass(frozen=True)
class Scene:
    """fields (pixel, owner) are drawn; samples (pixel, owner) say where gradients are measured; layers (image_id, owner,
    paint, name, role, r, g, b, opacity, graded, margin beyond the frame if not the frame's own, and the styles of
    geometry.path_table but scale); ground (image_id,
    role, r, g, b); points (pixel) may hold highlights; notes (image_id, ...) go into the plan."""

    fields: DataFrame
    samples: DataFrame
    layers: DataFrame
    ground: DataFrame
    points: DataFrame
    notes: DataFrame


def _kernel(fraction: float) -> Column:
    return scalars.gap_kernel(F.col("width"), F.col("height"), fraction) if fraction > 0 else F.lit(1)


def _seam(fraction: float) -> Column:
    return scalars.underlap(F.col("width"), F.col("height"), F.lit(fraction))


def _underlapped(field: DataFrame, occluder: DataFrame, frames: DataFrame, fraction: float) -> DataFrame:
    """A field with what it gains under an occluder that it nearly touches."""
    if fraction <= 0:
        return field.select(PIXEL)
    seam = _seam(fraction)
    return masks.union(field, stencils.seam_overlap(field, occluder, seam["clearance"], seam["margin"], frames))


def _layer_frames(layers: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of layers as images of their own: 32 numbers an image, so image ids stay below 2^58."""
    return layers.join(frames, "image_id").select((F.col("image_id") * 32 + F.col("paint")).alias("layer"), "image_id", "owner", "paint", "width", "height")


# ---------------------------------------------------------------- general
def labelled(pixels: DataFrame, frames: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels with r, g, b, L, a, bb, label; palette (image_id, label, r, g, b); features (image_id, kind, mark)).

    Labels by colour are smoothed twice. Where they do not follow an image well, spatial roles overwrite them; then come a
    support field, the focal island that it lies under, and an accent line.
    """
    line, (rows, islands, island, support) = K.at_once(
        pixels.sparkSession, lambda: K.stored(detect.ribbon(detect.accent_line(pixels, frames), frames)), lambda: _fields(pixels, frames, options)
    )
    claims = None
    for label, mask in ((ACCENT, line), (ISLAND, island), (SUPPORT, support)):
        mask = mask.select(*PIXEL, F.lit(label).alias("mark"))
        claims = mask if claims is None else claims.unionByName(mask)
    claims = K.stored(claims.groupBy(PIXEL).agg(F.max("mark").alias("mark")))
    rows = K.stored(masks.overwritten(rows, claims, new="mark"))
    inks = K.stored(aggregates.median_color(rows, ["image_id", "label"]).select("image_id", "label", "r", "g", "b"))
    kinds = islands.select("image_id", "kind")
    return rows, inks, claims.select("image_id", "mark").distinct().join(kinds, "image_id", "left")


def _fields(pixels: DataFrame, frames: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pixels labelled by colour and spatial role, islands, their pixels, pixels of their support fields)."""
    found, seeds = palette.quantised(pixels, options.palette_size)
    lab = K.stored(found.select(*PIXEL, "r", "g", "b", *_LAB, "label"))
    marks = lab.select(*PIXEL, "label")
    for _ in range(2):
        marks = K.stored(stencils.mode(marks, "label", 7, frames))
    rows = K.stored(lab.drop("label").join(marks.hint("merge"), PIXEL))
    sure = detect.quadrant_confidence(similar_roles(rows, seeds), frames)
    weak = K.stored(sure.groupBy("image_id").agg(F.min("confidence").alias("least")).where(F.col("least") < SURE).select("image_id"))
    if not K.without_rows(weak):
        spatial = repaired_roles(K.stored(pixels.join(weak, "image_id", "left_semi")), K.stored(frames.join(weak, "image_id", "left_semi")))
        rows = K.stored(masks.overwritten(rows, spatial, offset=SPATIAL))
    islands, island = detect.focal_masks(rows, frames, [SPATIAL, SPATIAL + 1, SPATIAL + 2])
    island = K.stored(island)
    lit = islands.where("kind = 'rare-chromatic'").select("image_id")
    if K.without_rows(lit):
        return rows, islands, island, island.where(F.lit(False))
    lit_pixels, lit_frames = (K.stored(df.join(lit, "image_id", "left_semi")) for df in (pixels, frames))
    return rows, islands, island, K.stored(detect.luminous_support(lit_pixels, lit_frames, island).select(PIXEL))


def similar_roles(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """rows with the margin between their two nearest roles, as a share of the farther distance."""
    packed = roles.groupBy("image_id").agg(F.collect_list(F.struct(*_LAB)).alias("_c"))
    gaps = F.array_sort(F.transform("_c", lambda c: color.oklab_distance([F.col(k) for k in _LAB], [c[k] for k in _LAB])))
    out = rows.join(packed.hint("merge"), "image_id").withColumn("_g", gaps)
    first, second = F.get("_g", F.lit(0)), F.coalesce(F.get("_g", F.lit(1)), F.lit(1.0))
    return out.withColumn("margin", (second - first) / F.greatest(F.lit(1e-9), second)).drop("_c", "_g")


def repaired_roles(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(pixel, priority): spatial roles in order of claim: corridor 0, silhouette 1, shore 2."""
    found = (lambda: detect.corridor_mask(detect.perspective_corridor(pixels, frames), frames), lambda: detect.silhouette(pixels, frames), lambda: detect.cool_shore(pixels, frames))
    stack = None
    for i, m in enumerate(K.at_once(pixels.sparkSession, *found)):
        m = m.select(*PIXEL, F.lit(i).alias("priority"))
        stack = m if stack is None else stack.unionByName(m)
    return masks.claimed(stack, frames)


def _selected(rows: DataFrame, inks: DataFrame, frames: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(samples, fields, regions, backgrounds, counts, totals): the regions chosen, and those with what was merged into them;
    counts (image_id, owner, ...) of what each took in, totals (image_id, closed_pixels, holes_filled)."""
    background = K.stored(aggregates.edge_mode(rows, frames))
    parts = K.stored(K.components(rows, "label"))
    chosen = K.stored(regions.within_budget(regions.scored(parts, frames, inks, background, options.detail, PROTECTED), options.max_shapes, [ISLAND, ACCENT]))
    keys = ["image_id", "component"]
    owned = K.stored(parts.join(chosen.select(*keys), keys, "left_semi").select(*PIXEL, "label", F.col("component").alias("owner")))
    lost = K.stored(parts.join(chosen.select(*keys), keys, "left_anti").join(background, "image_id").where("label <> background").select(*PIXEL, "label", "component"))
    lost_ink = lost.select(*keys, "label").distinct().join(inks, ["image_id", "label"]).drop("label")
    owner_ink = chosen.select("image_id", F.col("component").alias("owner"), "label").join(inks, ["image_id", "label"])
    owner = regions.merged_in_order(lost, owned.select(*PIXEL, "owner"), frames, lost_ink, owner_ink, PROTECTED)
    owner = K.stored(owner)
    counts = regions.merge_counts(owner, lost, owned).select("image_id", "owner", F.col("components").alias("merged_components"), F.col("pixels").alias("merged_pixels"))
    totals = frames.select("image_id", F.lit(0).cast("long").alias("closed_pixels"), F.lit(0).cast("long").alias("holes_filled"))
    whole = K.stored(owned.select(*PIXEL, "owner").unionByName(lost.join(owner.hint("merge"), keys).select(*PIXEL, "owner")))
    if options.min_negative_gap > 0:
        given, totals = regions.negative_space_parts(whole, frames, _kernel(options.min_negative_gap))
        given = K.stored(given)
        whole = K.stored(whole.unionByName(given.select(*PIXEL, "owner")))
        took = given.groupBy("image_id", "owner").agg(F.count_distinct("component").alias("reassigned_components"), F.count("*").alias("reassigned_pixels"))
        counts = counts.join(took, ["image_id", "owner"], "left")
    else:
        counts = counts.withColumns({"reassigned_components": F.lit(0).cast("long"), "reassigned_pixels": F.lit(0).cast("long")})
    return owned.select(*PIXEL, "owner"), whole, chosen, background, counts, totals


#: What each field took in or gained on the way, and the plan's map of it.
_COUNTERS = {
    "added": "seam_underlap_added_pixels", "holes": "micro_hole_pixels", "merged_components": "merged_components", "merged_pixels": "merged_pixels", "reassigned_components": "negative_space_components",
    "reassigned_pixels": "negative_space_pixels", "unrepresented_holes": "unrepresented_holes", "unrepresented_pixels": "unrepresented_hole_pixels", "false_background_holes": "false_background_holes", "false_background_pixels": "false_background_pixels",
}


def general(pixels: DataFrame, frames: DataFrame, options: Options) -> Scene:
    """Regions of palette labels in paint order. Each one extends under later ones that it nearly touches, and takes in its
    small holes and those that stand for nothing: discarded islands, and background of the field's own hue."""
    rows, inks, features = labelled(pixels, frames, options)
    features = K.stored(features)
    samples, whole, chosen, background, took, totals = _selected(rows, inks, frames, options)
    chosen = K.stored(chosen.select("image_id", F.col("component").alias("owner"), "label", "paint").join(inks, ["image_id", "label"]))
    wide = K.stored(_layer_frames(chosen, frames))
    sheets = wide.select(F.col("layer").alias("image_id"), "width", "height")
    own = wide.select("layer", "image_id", "owner", "paint")
    on_layer = lambda df, *cols: df.select(F.col("layer").alias("image_id"), *PIXEL[1:], *cols)
    field = K.stored(on_layer(whole.join(own, ["image_id", "owner"])))
    later = joins.later_union(whole.join(own, ["image_id", "owner"]).withColumnRenamed("paint", "ord").select("image_id", "ord", "y", "x"))
    later = on_layer(later.withColumnRenamed("ord", "paint").join(own.drop("owner"), ["image_id", "paint"]))
    drawn = K.stored(_underlapped(field, later, sheets, options.min_negative_gap))
    limit = F.pow(F.greatest(F.lit(1), F.rint(F.least("width", "height") * options.min_negative_gap)), F.lit(2)) if options.min_negative_gap > 0 else F.lit(0.0)
    full = K.stored(K.filled(drawn, sheets, limit).distinct())
    others = on_layer(whole.withColumnRenamed("owner", "_o").join(own, "image_id").where("_o <> owner"))
    back = rows.join(background, "image_id").where("label = background").select(PIXEL)
    back = on_layer(back.join(own, "image_id"))
    inner = K.stored(K.holes(full, sheets))
    unclaimed = regions.unclaimed_holes(full, others, back, sheets, inner=inner)
    tint = lambda df: df.select("image_id", *(c.alias(n) for c, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), _LAB, strict=True)))
    field_tint = tint(chosen.join(own, ["image_id", "owner", "paint"]).select(F.col("layer").alias("image_id"), "r", "g", "b"))
    ground = inks.join(background, "image_id").where("label = background").select("image_id", "r", "g", "b")
    back_tint = tint(own.select("image_id", "layer").join(ground, "image_id").select(F.col("layer").alias("image_id"), "r", "g", "b"))
    layered = on_layer(inner.select(F.col("image_id").alias("layer"), "y", "x").join(own, "layer").join(pixels.hint("merge"), PIXEL), "r", "g", "b")
    false = regions.chromatic_false_background(inner, layered, back, sheets, field_tint, back_tint)
    false = K.stored(inner.join(false.hint("merge"), ["image_id", "component"], "left_semi"))
    merged = lambda df, what: df.groupBy(F.col("image_id").alias("layer")).agg(F.count_distinct("component").alias(f"{what}_holes"), F.count("*").alias(f"{what}_pixels"))
    unclaimed = K.stored(inner.join(unclaimed.hint("merge"), PIXEL, "left_semi"))
    final = K.stored(masks.union(full, unclaimed.select(PIXEL), false.select(PIXEL)).withColumnRenamed("image_id", "layer").join(own, "layer").select(*PIXEL, "owner", "paint"))
    island, accent = F.col("label") == ISLAND, F.col("label") == ACCENT
    name = F.concat(F.lit("field-"), scalars.padded_id(F.col("paint")))
    styled = chosen.select(
        "image_id", "owner", "paint", name.alias("name"), F.lit(None).cast("string").alias("role"), "r", "g", "b", F.lit(1.0).alias("opacity"), (~accent).alias("graded"),
        F.when(accent, 1).alias("margin"), F.when(island, 1.65).otherwise(3.3 - 2.1 * options.detail).alias("tolerance"),
        F.when(island, min(options.curve_smoothing, 0.70)).otherwise(options.curve_smoothing).alias("smoothing"), F.lit(0).alias("budget"), F.lit("adaptive").alias("mode"), F.when(island, 2).otherwise(4).alias("passes"),
        (~F.col("label").isin(PROTECTED)).alias("micro"),
    )
    gained = drawn.unionByName(field).groupBy(PIXEL).agg(F.count("*").alias("n")).where("n = 1").groupBy("image_id").agg(F.count("*").alias("added")).withColumnRenamed("image_id", "layer")
    holes = full.unionByName(drawn).groupBy(PIXEL).agg(F.count("*").alias("n")).where("n = 1").groupBy("image_id").agg(F.count("*").alias("holes")).withColumnRenamed("image_id", "layer")
    counts = own.join(took, ["image_id", "owner"], "left")
    for part in (gained, holes, merged(unclaimed, "unrepresented"), merged(false, "false_background")):
        counts = counts.join(part, "layer", "left")
    counts = counts.na.fill(0, list(_COUNTERS)).withColumn("name", name)
    per = counts.groupBy("image_id").agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", c)))).alias(n) for c, n in _COUNTERS.items()), F.sum("false_background_holes").alias("_false"))
    for c in ("false_background_holes", "false_background_pixels"):  # said only where there is something to say
        per = per.withColumn(_COUNTERS[c], F.when(F.col("_false") > 0, F.col(_COUNTERS[c])))
    kernel = _kernel(options.min_negative_gap)
    noted = frames.select("image_id", kernel.cast("int").alias("negative_space_kernel"), (kernel * kernel).cast("long").alias("negative_space_hole_limit"), F.lit(4).alias("contour_low_passes"), F.lit(2).alias("compact_contour_low_passes"))
    noted = noted.join(totals.select("image_id", F.col("closed_pixels").alias("negative_space_closed_pixels"), F.col("holes_filled").alias("negative_space_holes_filled")), "image_id", "left")
    per = per.drop("_false").join(noted.na.fill(0), "image_id")
    return Scene(final.drop("paint"), samples, styled, ground.withColumn("role", F.lit(None).cast("string")), masks.frame_grid(frames), _general_notes(rows, inks, features, per, frames, limit))


def _general_notes(rows: DataFrame, inks: DataFrame, features: DataFrame, per: DataFrame, frames: DataFrame, limit: Column) -> DataFrame:
    shares = K.stored(aggregates.reconciled(aggregates.populations(rows), "label"))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("label", value.alias("v")))), lambda c: c["v"])
    hexed = color.rgb_hex(F.col("r"), F.col("g"), F.col("b"))
    roles = shares.join(inks, ["image_id", "label"]).groupBy("image_id").agg(ordered(hexed).alias("palette_seed_colors"), ordered(F.col("fraction")).alias("palette_population_fractions"))
    seen = shares.join(features.select("image_id", F.col("mark").alias("label")), ["image_id", "label"], "left_semi").groupBy("image_id").agg(*(F.collect_list(F.when(F.col("label") == mark, F.col("fraction"))).alias(n) for mark, n in ((ISLAND, "i"), (SUPPORT, "s"), (ACCENT, "a"))))
    kinds = features.where(F.col("mark") == ISLAND).select("image_id", F.col("kind").alias("compact_salient_island_kind"))
    notes = frames.select("image_id", limit.cast("long").alias("micro_hole_limit")).join(roles, "image_id").join(per, "image_id", "left").join(seen, "image_id", "left").join(kinds, "image_id", "left")
    for short, long in (("i", "compact_salient_island"), ("s", "focal_support_field"), ("a", "perspective_accent_line")):
        notes = notes.withColumn(f"{long}_area_fractions", F.coalesce(short, F.array().cast("array<double>"))).withColumn(f"{long}_count", F.size(f"{long}_area_fractions")).drop(short)
    return notes.withColumn("curve_model", F.lit("adaptive cubic Bezier"))


# ---------------------------------------------------------------- shared by the fixed compositions
def _scene(roles: list[tuple[str, DataFrame, DataFrame, float | None, dict]], pixels: DataFrame, ground: DataFrame, points: DataFrame, notes: DataFrame) -> Scene:
    """A Scene of named masks (name, drawn, sampled, share, style) in paint order; share is the percentile of the mask's
    colour, the median if none. Empty masks make no layer."""
    fields = samples = layers = None
    for i, (name, drawn, sampled, share, style) in enumerate(roles):
        own = style | {"owner": i, "paint": i + 1, "name": name}
        drawn, sampled = (df.select(*PIXEL, F.lit(i).cast("long").alias("owner")) for df in (drawn, sampled))
        values = pixels.join(sampled.hint("merge"), PIXEL)
        ink = aggregates.median_color(values, ["image_id"]).drop("population") if share is None else aggregates.percentile_color(values, ["image_id"], share)
        layer = ink.select("image_id", "r", "g", "b", *(F.lit(v).cast(_TYPES.get(k, "string")).alias(k) for k, v in own.items()), F.lit(None).cast("int").alias("margin"))
        fields, samples, layers = (b if a is None else a.unionByName(b) for a, b in ((fields, drawn), (samples, sampled), (layers, layer)))
    return Scene(K.stored(fields), K.stored(samples), K.stored(layers), ground, points, notes)


_TYPES = {"owner": "long", "paint": "int", "budget": "int", "passes": "int", "opacity": "double", "tolerance": "double", "smoothing": "double", "graded": "boolean", "micro": "boolean"}


def _style(role: str | None, tolerance: float, smoothing: float, **other) -> dict:
    return {"role": role, "opacity": 1.0, "graded": True, "tolerance": tolerance, "smoothing": min(1.0, smoothing), "budget": 0, "mode": "bspline", "passes": 2, "micro": False} | other


# ---------------------------------------------------------------- night
def night_masks(pixels: DataFrame, frames: DataFrame, options: Options) -> dict[str, DataFrame]:
    """foreground, luminous and light pixels of night scenes.

    The foreground grows from warm pixels that the lower edge reaches, with nearby shadow, and is everything that the sky
    does not reach from above. The luminous field is the brightest broad part of the sky, light that of the foreground.
    """
    f, w = F.col("height"), F.col("width")
    base = K.stored(pixels.select(*PIXEL, color.luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"), (color.clamp(color.warmth(F.col("r"), F.col("b")) + 128, 0, 255)).alias("warm")).join(frames, "image_id"))
    at_least = lambda low, part: F.greatest(F.lit(low), w / part)
    soft = stencils.blurred(base, "warm", at_least(1.15, 380.0)).withColumn("warm", F.col("warm") - 128)
    soft = K.stored(soft.join(stencils.blurred(base, "lum", at_least(1.0, 460.0)).hint("merge"), PIXEL).join(frames, "image_id").withColumn("down", F.col("y") / F.greatest(F.lit(1), f - 1)))
    floor = base.where(F.col("y") < F.greatest(F.lit(2), F.rint(f * 0.28))).groupBy("image_id").agg(F.percentile("lum", F.lit(0.34)).alias("floor"))
    up = 1 - F.col("down")
    seed = soft.join(floor.hint("merge"), "image_id").where(((F.col("warm") > up * 6 + 15) & (F.col("lum") > F.greatest(F.lit(20.0), F.col("floor") + 2)) & (F.col("down") > 0.245)) | (F.col("y") >= f - F.greatest(F.lit(2), F.rint(f * 0.012))))
    seed = K.stored(stencils.cleaned(seed.select(PIXEL), 5, 5, frames))
    shade = soft.where((F.col("warm") > up * 3 + 5) & (F.col("lum") > 16) & (F.col("down") > 0.245)).select(PIXEL)
    near = masks.intersection(stencils.dilated(seed, 9, frames), shade)
    land = stencils.cleaned(masks.union(seed, near), 5, 5, frames)
    land = K.below_sky(K.bottom_connected(land, frames, F.greatest(F.lit(3), F.rint(f * 0.010))), frames)
    open_land = K.stored(land)
    land = K.stored(stencils.gap_closed(open_land, _kernel(options.min_negative_gap), frames).select(PIXEL))
    sky = K.stored(masks.complement(land, frames))
    broad = stencils.blurred(base, "lum", at_least(5.0, 31.0)).join(soft.select(*PIXEL, "down", "width").hint("merge"), PIXEL)
    broad = broad.join(sky.hint("merge"), PIXEL, "left_semi")
    limit = broad.groupBy("image_id").agg(F.percentile("lum", F.lit(0.84)).alias("limit"))
    glow = stencils.cleaned(broad.join(limit.hint("merge"), "image_id").where((F.col("lum") >= F.col("limit")) & (F.col("down") < 0.93)).select(PIXEL), 7, 7, frames)
    glow = K.stored(K.largest(stencils.smoothed_boundary(glow, at_least(2.5, 170.0), frames), frames, 0.009, 2))
    thin = K.measures(glow).join(frames, "image_id").where("(x0 <= 1 or x1 >= width - 2) and x1 - x0 + 1 < width * 0.14")
    glow = K.stored(glow.join(thin.hint("merge"), ["image_id", "component"], "left_anti").select(PIXEL))
    value = stencils.blurred(base, "lum", at_least(4.0, 54.0)).join(soft.select(*PIXEL, "down").hint("merge"), PIXEL).join(land.hint("merge"), PIXEL, "left_semi")
    limit = value.groupBy("image_id").agg(F.percentile("lum", F.lit(0.72)).alias("limit"))
    bright = value.join(limit.hint("merge"), "image_id").where(F.col("lum") >= F.col("limit") + color.clamp((F.col("down") - 0.68) / 0.32, 0.0, 1.0) * 22).select(PIXEL)
    light = K.filled(K.stored(stencils.cleaned(bright, 7, 7, frames)), frames)
    light = K.stored(stencils.smoothed_boundary(light, at_least(3.0, 120.0), frames))
    light = stencils.rounded_tips(light, _kernel(min(0.040, options.min_negative_gap * 1.35)), frames)
    light = K.stored(stencils.smoothed_boundary(light, at_least(1.8, 260.0), frames))
    light = K.stored(light)
    snapped = masks.intersection(K.largest(light, frames, 0.0075, 2), land)
    return {"foreground": land, "sky": sky, "luminous": glow, "light": snapped, "unclosed": open_land, "unsnapped": light}


def night(pixels: DataFrame, frames: DataFrame, options: Options) -> Scene:
    """At most three fields: a translucent part of the sky, the land, and its lit part, which ends at the land's outline."""
    m = night_masks(pixels, frames, options)
    gap, smooth, detail = options.min_negative_gap, options.curve_smoothing, options.detail
    land = K.largest(m["foreground"], frames, 0.0035, 2)
    glow = _underlapped(m["luminous"], m["foreground"], frames, gap)
    lit = K.filled(K.stored(_underlapped(m["light"], m["sky"], frames, min(0.060, gap * 2.2))), frames)
    roles = [
        ("luminous-sky-field", glow, masks.intersection(m["luminous"], m["sky"]), 0.86, _style("luminous-inner", 2.65 - 0.42 * detail, smooth + 0.16, budget=48, opacity=0.16)),
        ("foreground-silhouette", land, m["foreground"], 0.62, _style("foreground", 1.64 - 0.58 * detail, smooth, budget=132)),
        ("foreground-light", masks.intersection(lit, m["foreground"]), m["light"], None, _style("light", 2.75 - 0.38 * detail, smooth + 0.14, budget=36, passes=4)),
    ]
    ground = aggregates.percentile_color(pixels.join(m["sky"].hint("merge"), PIXEL, "left_semi"), ["image_id"], 0.24).withColumn("role", F.lit("sky"))
    points = m["sky"].join(frames, "image_id").where(F.col("y") < F.greatest(F.lit(1), F.col("height") - 1) * 0.79).select(PIXEL)
    notes = frames.select(
        "image_id", F.lit("periodic cubic B-spline").alias("curve_model"), F.lit("warm seed, shadow nearby, what the sky does not reach, narrow gaps closed").alias("foreground_segmentation"),
        _kernel(gap).cast("int").alias("gap_closure_kernel"), F.lit("tips rounded, light cut at the outline of the land").alias("internal_contour_policy"),
        F.create_map(F.lit("foreground-light"), _kernel(min(0.040, gap * 1.35)).cast("int")).alias("internal_rounding_kernels"),
    )
    size = lambda df, n: df.groupBy("image_id").agg(F.count("*").cast("long").alias(n))
    for part in (size(masks.difference(m["foreground"], m["unclosed"]), "gap_pixels_closed"), size(masks.difference(glow, m["luminous"]), "_glow"), size(masks.difference(lit, m["light"]), "_lit"), size(masks.difference(m["unsnapped"], m["light"]), "_cut")):
        notes = notes.join(part, "image_id", "left")
    notes = notes.na.fill(0, ["gap_pixels_closed", "_glow", "_lit", "_cut"])
    notes = notes.withColumn("seam_underlap_added_pixels", F.create_map(F.lit("luminous-sky-field"), F.col("_glow"), F.lit("foreground-light"), F.col("_lit"))).withColumn("internal_edge_snap_pixels", F.create_map(F.lit("foreground-light"), F.col("_cut")))
    return _scene(roles, pixels, ground, points, notes.drop("_glow", "_lit", "_cut"))


# ---------------------------------------------------------------- mirrored
def reflective_masks(pixels: DataFrame, frames: DataFrame, axes: DataFrame) -> dict[str, DataFrame]:
    """Masks of mirrored scenes by role, in paint order: sky, water, terrain above the axis by its outer contour and its
    mirror image, vegetation and bright rock within both, and the shore."""
    top = K.stored(detect.outer_contour(pixels, axes))
    rows = pixels.join(axes.select("image_id", "axis"), "image_id").join(frames, "image_id")
    terrain = K.stored(rows.join(top.hint("merge"), ["image_id", "x"]).where("y >= top and y < axis").select(PIXEL))
    broad = rows.select(*PIXEL, *(F.col(c).cast("double").alias(c) for c in "rgb"))
    for c in "rgb":
        broad = stencils.gaussian(broad, c, 5.5)
    lab = K.stored(detect.with_oklab(broad.join(terrain.hint("merge"), PIXEL, "left_semi")).withColumn("chroma", color.chroma([F.col(c) for c in _LAB])).select(*PIXEL, *_LAB, "chroma"))
    lim = lab.groupBy("image_id").agg(F.percentile("L", F.lit(0.57)).alias("light"), F.percentile("chroma", F.lit(0.52)).alias("grey"), F.percentile("L", F.lit(0.64)).alias("shade"))
    at = K.stored(lab.join(lim.hint("merge"), "image_id"))

    def part(seed: DataFrame, closing: int, size: int, radius: float, share: float) -> DataFrame:
        soft = stencils.smoothed_boundary(K.stored(stencils.cleaned(seed.select(PIXEL), closing, size, frames)), radius, frames)
        return K.stored(K.largest(masks.intersection(soft, terrain), frames, share, 2).select(PIXEL))

    rock, green = K.at_once(
        pixels.sparkSession, lambda: part(at.where("L >= light and chroma <= grey"), 13, 11, 5.5, 0.012), lambda: part(at.where("a < -0.012 and bb > 0.010 and L < shade"), 11, 9, 4.5, 0.006)
    )

    def below(mask: DataFrame) -> DataFrame:
        return masks.mirrored(mask.join(axes.select("image_id", "axis"), "image_id"), F.col("axis")).join(frames, "image_id").where("y < height").select(PIXEL)

    mirror = K.stored(below(terrain))
    inside = lambda mask: masks.intersection(below(mask), mirror)
    pick = lambda condition: rows.where(condition).select(PIXEL)
    return {
        "sky": pick("y < axis"), "water": pick("y >= axis"), "upper-terrain": terrain, "reflected-terrain": mirror, "upper-vegetation": green, "reflected-vegetation": inside(green),
        "upper-rock-light": rock, "reflected-rock-light": inside(rock), "shore-divider": pick("y >= axis - 2 and y < axis + 4"),
    }


def reflective(pixels: DataFrame, frames: DataFrame, options: Options) -> Scene:
    """Paired fields about the measured axis; both halves keep the colours they have."""
    found = K.stored(detect.reflection(pixels, frames))
    m = reflective_masks(pixels, frames, found)
    style = _style(None, 2.25, min(0.92, options.curve_smoothing + 0.04), mode="adaptive", passes=4)
    sky = K.stored(masks.difference(m["sky"], m["upper-terrain"]))
    roles = [(name, mask, sky if name == "sky" else mask, None, style | {"graded": name != "shore-divider"}) for name, mask in m.items()]
    ground = aggregates.median_color(pixels.join(sky.hint("merge"), PIXEL, "left_semi"), ["image_id"]).select("image_id", "r", "g", "b", F.lit(None).cast("string").alias("role"))
    notes = found.select("image_id", F.col("axis").alias("reflection_axis"), *(F.round(c, 6).alias(f"reflection_{n}") for c, n in (("score", "score"), ("light", "lightness_correlation"), ("chroma", "chroma_correlation"), ("edge", "edge_correlation"))))
    return _scene(roles, pixels, ground, pixels.select(PIXEL).where(F.lit(False)), notes.withColumn("curve_model", F.lit("adaptive cubic Bezier")))
