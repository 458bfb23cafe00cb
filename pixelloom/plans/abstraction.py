"""From pixels to vector documents: each image composed by its archetype, then outlines, gradients, texture and plan.

Everything runs for all images of a table at once; an image is a key, never a loop on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import detect, document, geometry, masks, regions
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL
from pixelloom.plans import scenes
from pixelloom.plans.options import Options
from pixelloom.sources.raster import frames as frames_of
from pixelloom.sources.raster import resized

#: How images of an archetype are composed.
COMPOSITIONS = {"night-landscape": scenes.night, "reflective-horizontal-landscape": scenes.reflective, "general": scenes.general}


def archetypes(pixels: DataFrame, frames: DataFrame, options: Options) -> DataFrame:
    """(image_id, archetype): as forced, or night before reflective before general."""
    if options.archetype != "auto":
        return frames.select("image_id", F.lit(options.archetype).alias("archetype"))
    night = detect.night_gate(pixels).select("image_id", "night")
    mirror = detect.reflection(pixels, frames).select("image_id", "reflective")
    kind = F.when(F.coalesce("night", F.lit(False)), "night-landscape").when(F.coalesce("reflective", F.lit(False)), "reflective-horizontal-landscape").otherwise("general")
    return frames.join(night, "image_id", "left").join(mirror, "image_id", "left").select("image_id", kind.alias("archetype"))


def composed(pixels: DataFrame, frames: DataFrame, kinds: DataFrame, options: Options) -> scenes.Scene:
    """One Scene of all images. Archetypes that no image has are not planned; at most three names reach the driver."""

    def composition(kind: str) -> scenes.Scene:
        own = kinds.where(F.col("archetype") == kind).select("image_id")
        return COMPOSITIONS[kind](K.stored(pixels.join(own, "image_id", "left_semi")), K.stored(frames.join(own, "image_id", "left_semi")), options)

    present = sorted(kind for (kind,) in kinds.select("archetype").distinct().collect())
    out = None
    for scene in K.at_once(pixels.sparkSession, *(lambda kind=kind: composition(kind) for kind in present)):
        scene = [getattr(scene, part) for part in scenes.Scene.__dataclass_fields__]
        out = scene if out is None else [a.unionByName(b, allowMissingColumns=True) for a, b in zip(out, scene, strict=True)]
    return scenes.Scene(*out)


def outlines(scene: scenes.Scene, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (image_id, owner, ax, ay, bx, by), touched (image_id, owner, edges)) of fields, which bleed past the frame."""
    sheet = K.stored(scene.layers.join(frames, "image_id").select((F.col("image_id") * 32 + F.col("paint")).alias("layer"), "image_id", "owner", "width", "height", F.coalesce("margin", scalars.bleed_margin(F.col("width"), F.col("height"))).alias("margin")))
    sheets = sheet.select(F.col("layer").alias("image_id"), "width", "height", "margin")
    fields = K.stored(scene.fields.join(sheet.select("image_id", "owner", "layer"), ["image_id", "owner"]).select(F.col("layer").alias("image_id"), "y", "x"))
    own = sheet.select("layer", "image_id", "owner")
    named = lambda df, *cols: df.withColumnRenamed("image_id", "layer").join(own, "layer").select("image_id", "owner", *cols)
    wide = named(regions.bled(fields, sheets, F.col("margin")), "y", "x")
    return regions.boundary_edges(wide, "owner"), named(masks.touched_edges(fields, sheets.drop("margin")), "edges")


def abstraction(pixels: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(image_id, svg, plan) for each image of pixels (image_id, y, x, r, g, b), analysed at options.analysis_size.

    Image ids are whole numbers below 2^58. Images without pixels do not occur; other columns are ignored. An image none of
    whose fields stands is its ground alone.
    """
    pixels = K.stored(resized(pixels.select(*PIXEL, "r", "g", "b"), options.analysis_size).select(*PIXEL, "r", "g", "b"))
    frames = K.stored(frames_of(pixels))
    kinds = K.stored(archetypes(pixels, frames, options))
    empty = K.without_rows(kinds)
    if empty:
        return kinds.select("image_id", F.lit("").alias("svg"), F.lit("").alias("plan"))
    scene = composed(pixels, frames, kinds, options)
    edges, touched = outlines(scene, frames)
    scales = frames.select("image_id", (F.lit(float(options.width)) / F.col("width")).alias("scale"))
    layers = K.stored(scene.layers)
    paths = geometry.path_table(edges, "owner", styles=layers.join(scales, "image_id"))
    graded = scene.samples.join(layers.where("graded").select("image_id", "owner"), ["image_id", "owner"], "left_semi")
    tint = geometry.source_gradients(pixels.join(graded.hint("merge"), PIXEL), ["image_id", "owner"], frames, options.gradient_strength).select("image_id", "owner", "axis", "stops")
    area = scene.fields.groupBy("image_id", "owner").agg(F.count("*").alias("area"))
    for part in (paths, tint, touched, area):
        layers = layers.join(part, ["image_id", "owner"], "left")
    inked = lambda: color.output_color(F.col("r"), F.col("g"), F.col("b"), options.color_mode, F.col("role"))
    hexed = lambda c: color.rgb_hex(F.col(f"{c}.r"), F.col(f"{c}.g"), F.col(f"{c}.b"))
    layers = layers.withColumn("c", inked()).withColumn("fill", hexed("c")).withColumn("source", color.rgb_hex(F.col("r"), F.col("g"), F.col("b")))
    gradient = document.gradient_def(F.concat(F.lit("g-"), "name"), F.col("axis"), F.col("stops"))
    layers = layers.where("path <> ''").withColumn("gradient", F.when(F.col("axis").isNotNull(), gradient))
    ground = scene.ground.withColumn("c", inked()).select("image_id", hexed("c").alias("fill"))
    canvas = K.stored(frames.join(scales, "image_id").select("image_id", F.lit(options.width).alias("width"), F.rint(F.col("height") * F.col("scale")).cast("int").alias("height")))
    rough = options.paper_style == "rough"
    texture = lambda: K.stored(document.texture(canvas, options.paper, options.paper_density, options.seed)) if rough else None
    layers, points, specks = K.at_once(pixels.sparkSession, lambda: K.stored(layers), lambda: _points(pixels, frames, scene, scales, options), texture)
    grain = options.paper if options.paper_style == "grain" else options.grain_overlay
    svg = document.documents(canvas, layers, ground, points, specks, grain=grain)
    plans = canvas.join(kinds, "image_id").join(scene.notes, "image_id", "left").join(_counts(layers, points, specks), "image_id", "left").join(_shares(layers, ground, frames), "image_id", "left")
    for short in ("compact_salient_island", "focal_support_field", "perspective_accent_line"):  # scenes without them say so
        for key, none in ((f"{short}_area_fractions", F.array().cast("array<double>")), (f"{short}_count", F.lit(0))):
            plans = plans.withColumn(key, F.coalesce(F.col(key), none) if key in plans.columns else none)
    if "palette_seed_colors" not in plans.columns:
        plans = plans.withColumns({"palette_seed_colors": F.lit(None).cast("array<string>"), "palette_population_fractions": F.lit(None).cast("array<double>")})
    seeds = F.col("palette_seed_colors").isNull()  # fixed compositions: their fields and the ground, by area
    plans = plans.withColumn("palette_population_fractions", F.when(seeds, F.col("_shares")).otherwise(F.col("palette_population_fractions"))).withColumn("palette_seed_colors", F.when(seeds, F.col("_inks")).otherwise(F.col("palette_seed_colors"))).drop("_shares", "_inks")
    plans = plans.na.fill(0, ["shape_count", "gradient_count", "point_count", "particle_count"])
    fixed = {"renderer": "native SVG paths", "frame_edge_policy": "fields bleed past the frame and the root clips them", "color_mode": options.color_mode, "paper_style": options.paper_style, "paper": options.paper, "paper_density": options.paper_density, "grain_overlay": options.grain_overlay, "curve_smoothing": options.curve_smoothing, "gradient_strength": options.gradient_strength, "min_negative_gap": options.min_negative_gap, "seed": options.seed}
    model = {"grain": "grain", "rough": "vector particles"}[options.paper_style] + (" with grain" if options.grain_overlay else "")
    fixed["paper_texture_model"] = model if options.paper > 0 else "none"
    plans = document.plan_json(plans.select("*", *(F.lit(v).alias(k) for k, v in fixed.items())))
    return svg.join(plans, "image_id", "left")


def _shares(layers: DataFrame, ground: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, _inks, _shares): colours of fields and ground by the area they were given, fields that lie over others too."""
    rows = layers.select("image_id", "fill", "area").unionByName(ground.join(frames, "image_id").select("image_id", "fill", (F.col("width") * F.col("height")).cast("long").alias("area")))
    rows = rows.groupBy("image_id", "fill").agg(F.sum("area").alias("area"))
    cells = F.array_sort(F.collect_list(F.struct("fill", "area")))
    total = F.sum("area")
    return rows.groupBy("image_id").agg(F.transform(cells, lambda c: c["fill"]).alias("_inks"), cells.alias("_c"), total.alias("_t")).select("image_id", "_inks", F.transform("_c", lambda c: c["area"] / F.col("_t")).alias("_shares"))


def _points(pixels: DataFrame, frames: DataFrame, scene: scenes.Scene, scales: DataFrame, options: Options) -> DataFrame | None:
    if not options.points:
        return None
    found = document.highlights(pixels, frames, options.seed, scene.points).withColumnRenamed("r", "radius").join(pixels.select(*PIXEL, "r", "g", "b").hint("merge"), PIXEL).join(scales, "image_id")
    star = color.rgb_hex(*(color.star_color(F.col(c)) for c in "rgb"))
    return K.stored(found.select("image_id", "n", *(((F.col(c) + 0.5) * F.col("scale")).alias(c) for c in "xy"), (F.col("radius") * F.col("scale")).alias("r"), star.alias("fill")))


def _counts(layers: DataFrame, points: DataFrame | None, specks: DataFrame | None) -> DataFrame:
    """What a plan says about its document, one row an image with fields."""
    by_name = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", value))))
    out = layers.groupBy("image_id").agg(
        F.count("*").cast("int").alias("shape_count"), F.count("gradient").cast("int").alias("gradient_count"), F.array_sort(F.collect_set("fill")).alias("palette"), F.array_sort(F.collect_set("source")).alias("sampled_palette"),
        by_name("edges").alias("frame_edges"), by_name("area").alias("field_pixels"),
    )
    for rows, name in ((points, "point_count"), (specks, "particle_count")):
        own = layers.select("image_id", F.lit(0).alias(name)).where(F.lit(False)) if rows is None else rows.groupBy("image_id").agg(F.count("*").cast("int").alias(name))
        out = out.join(own, "image_id", "full")
    return out
