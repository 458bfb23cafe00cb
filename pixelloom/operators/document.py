"""Vector documents: layers to SVG text, paper texture, highlights, and the plan that goes with a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.functions.color import rgb_hex
from pixelloom.functions.scalars import fixed, xml_escape
from pixelloom.operators import stencils
from pixelloom.operators.joins import spaced

#: At most so many highlights; band of rows they may stand in; limits of brightness.
MOST_HIGHLIGHTS, SKY_SHARE, DARK_ENOUGH = 32, 0.82, 105
GRAIN_FILTER = '<filter id="surface-grain-filter"><feTurbulence type="fractalNoise" baseFrequency="0.8" numOctaves="2"/><feColorMatrix type="saturate" values="0"/></filter>'


def gradient_def(name: Column, axis: Column, stops: Column) -> Column:
    """A linearGradient element with three stops."""
    place = {"horizontal": "0 0.5 1 0.5", "vertical": "0.5 0 0.5 1", "diagonal-down": "0 0 1 1", "diagonal-up": "0 1 1 0"}
    out = F.lit("")
    for k, v in place.items():
        x1, y1, x2, y2 = v.split()
        out = F.when(axis == k, F.lit(f' x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}">')).otherwise(out)
    parts = [F.concat(F.lit(f'<stop offset="{o}" stop-color="'), rgb_hex(stops[i]["r"], stops[i]["g"], stops[i]["b"]), F.lit('"/>')) for i, o in enumerate(("0", "0.5", "1"))]
    return F.concat(F.lit('<linearGradient id="'), xml_escape(name), F.lit('"'), out, *parts, F.lit("</linearGradient>"))


def path_element(name: Column, path: Column, fill: Column, opacity: Column) -> Column:
    alpha = F.when(opacity < 1, F.concat(F.lit(' fill-opacity="'), fixed(opacity, 3), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<path id="'), xml_escape(name), F.lit('" d="'), path, F.lit('" fill="'), fill, F.lit('"'), alpha, F.lit("/>"))


def circle_element(x: Column, y: Column, r: Column, fill: Column) -> Column:
    return F.concat(F.lit('<circle cx="'), fixed(x), F.lit('" cy="'), fixed(y), F.lit('" r="'), fixed(r), F.lit('" fill="'), fill, F.lit('"/>'))


def texture(frames: DataFrame, paper: float, density: float, seed: int) -> DataFrame:
    """(image_id, kind, i, x, y, length, angle, opacity): paper fibres, dark and light specks. Their number follows the area
    and the density; each draw is a hash of (seed, image, kind, i, draw), so it does not depend on partitions."""
    area = F.col("width") * F.col("height")
    kinds = (("fibre", 72, 12000, density**0.5), ("dark", 320, 2100, density), ("light", 120, 6200, density))
    n = F.array(*(F.struct(F.lit(k).alias("kind"), F.greatest(F.lit(low), F.floor(area / per * d)).cast("int").alias("n")) for k, low, per, d in kinds))
    rows = frames.where(F.lit(paper > 0)).select("image_id", "width", "height", F.explode(n).alias("k")).select("image_id", "width", "height", "k.kind", F.explode(F.sequence(F.lit(0), F.col("k.n") - 1)).alias("i"))
    u = lambda d: F.pmod(F.xxhash64(F.lit(seed + 2048), "image_id", "kind", "i", F.lit(d)), F.lit(1_000_000)) / 1_000_000.0
    size = F.when(F.col("kind") == "fibre", u(2) * 9 + 5).when(F.col("kind") == "dark", u(2) * 0.9 + 0.4).otherwise(u(2) * 0.8 + 0.4)
    return rows.select("image_id", "kind", "i", (u(0) * F.col("width")).alias("x"), (u(1) * F.col("height")).alias("y"), size.alias("length"), (u(3) * 180).alias("angle"), ((u(4) * 0.5 + 0.5) * paper * F.when(F.col("kind") == "fibre", 0.22).otherwise(0.30)).alias("opacity"))


def particle_element(kind: Column, x: Column, y: Column, length: Column, angle: Column, opacity: Column) -> Column:
    ink = F.when(kind == "dark", "#2A2622").when(kind == "light", "#FFFFFF").otherwise("#6B6258")
    high = F.when(kind == "fibre", F.lit(0.5)).otherwise(length)
    return F.concat(
        F.lit('<rect x="'), fixed(x), F.lit('" y="'), fixed(y), F.lit('" width="'), fixed(length), F.lit('" height="'), fixed(high),
        F.lit('" transform="rotate('), fixed(angle), F.lit(" "), fixed(x), F.lit(" "), fixed(y), F.lit(')" fill="'), ink, F.lit('" fill-opacity="'), fixed(opacity, 3), F.lit('"/>'),
    )


def highlights(pixels: DataFrame, frames: DataFrame, seed: int = 17, allowed: DataFrame | None = None) -> DataFrame:
    """(image_id, n, x, y, r, score): bright points of dark images, no two close together, the best 32.

    A point stands out from its surroundings by more than nearly all others, is bright, and its surroundings are not. Its
    score is by how much it stands out and a share of its brightness; the distance kept follows the frame.
    """
    rows = pixels.join(frames, "image_id").withColumn("grey", color.grey(F.col("r"), F.col("g"), F.col("b")).cast("double"))
    rows = stencils.gaussian(rows.withColumn("soft", F.col("grey")), "soft", 2.3).withColumn("detail", F.col("grey") - F.col("soft"))
    upper = rows.where(F.col("y") < F.greatest(F.lit(2.0), F.rint(F.col("height") * SKY_SHARE)))
    lim = upper.groupBy("image_id").agg(F.avg("grey").alias("mean"), F.greatest(F.lit(9.0), F.percentile("detail", F.lit(0.9915))).alias("most"), F.greatest(F.lit(80.0), F.percentile("grey", F.lit(0.82))).alias("bright"))
    found = upper.join(lim.where(F.col("mean") <= DARK_ENOUGH).hint("merge"), "image_id").where("detail >= most and grey >= bright and soft <= 145")
    if allowed is not None:
        found = found.join(allowed.select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"], "left_semi")
    enough = found.groupBy("image_id").agg(F.count("*").alias("n")).where("n >= 24").select("image_id")
    apart = F.greatest(F.lit(4.0), F.least("width", "height") * 0.022)
    found = found.join(enough.hint("merge"), "image_id", "left_semi").select("image_id", "x", "y", (F.col("detail") + F.col("grey") * 0.18).alias("score"), apart.alias("apart"))
    kept = spaced(found, "apart", "score")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "y", "x"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "image_id", "x", "y"), F.lit(1000)) / 1000.0 * 0.24 - 0.12
    strength = color.clamp(F.col("score") / 170.0, 0.25, 1.0)
    return kept.withColumn("n", rank).where(F.col("n") <= MOST_HIGHLIGHTS).select("image_id", "n", "x", "y", (strength * 1.2 + 0.7 + draw).alias("r"), "score")


def _grain_rect(name: str, grain: float) -> str:
    return f'<rect id="{name}" width="100%" height="100%" filter="url(#surface-grain-filter)" opacity="{0.32 * grain:.3f}"/>'


def documents(frames: DataFrame, layers: DataFrame, ground: DataFrame, points: DataFrame | None = None, particles: DataFrame | None = None, title: str = "Abstraction", grain: float = 0.0) -> DataFrame:
    """(image_id, svg): defs, ground, fields in paint order, highlights, and the texture on top.

    layers (image_id, paint, name, path, fill, opacity, gradient); gradient is a definition or null. ground (image_id, fill). points (image_id, n, x, y, r, fill).
    Layers without a path are left out. grain above 0 lays turbulence of that strength over everything.
    """

    def ordered(df: DataFrame, text: Column, order: list[str], name: str) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
        return df.groupBy("image_id").agg(F.array_join(F.transform(cells, lambda c: c["t"]), "").alias(name))

    drawn = layers.where(F.length("path") > 0)
    fill = F.when(F.col("gradient").isNotNull(), F.concat(F.lit("url(#g-"), xml_escape(F.col("name")), F.lit(")"))).otherwise(F.col("fill"))
    out = frames.join(ground.select("image_id", F.col("fill").alias("ground")), "image_id")
    out = out.join(ordered(drawn, path_element(F.col("name"), F.col("path"), fill, F.col("opacity")), ["paint", "name"], "fields"), "image_id", "left")
    out = out.join(ordered(drawn.where(F.col("gradient").isNotNull()), F.col("gradient"), ["paint", "name"], "defs"), "image_id", "left")
    empty = F.lit("")
    dots = specks = empty
    if points is not None:
        out = out.join(ordered(points, circle_element(F.col("x"), F.col("y"), F.col("r"), F.col("fill")), ["n"], "dots"), "image_id", "left")
        dots = F.coalesce(F.concat(F.lit('<g id="point-highlights">'), F.col("dots"), F.lit("</g>")), empty)
    if particles is not None:
        out = out.join(ordered(particles, particle_element(*(F.col(c) for c in ("kind", "x", "y", "length", "angle", "opacity"))), ["kind", "i"], "specks"), "image_id", "left")
        over = F.lit(_grain_rect("surface-grain", grain) if grain else "")
        specks = F.coalesce(F.concat(F.lit('<g id="surface-noise-layer">'), F.col("specks"), over, F.lit("</g>")), empty)
    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    svg = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" overflow="hidden"><title>'), xml_escape(F.lit(title)),
        F.lit("</title><desc>Fields derived from one source</desc><defs>"), F.coalesce("defs", empty), F.lit(GRAIN_FILTER if grain else ""), F.lit('</defs><rect width="100%" height="100%" fill="'), F.col("ground"),
        F.lit('"/><g id="source-derived-fields">'), F.coalesce("fields", empty), F.lit("</g>"), dots, F.lit(_grain_rect("surface-noise-layer", grain) if grain and particles is None else ""), specks, F.lit("</svg>"),
    )
    return out.select("image_id", svg.alias("svg"))


def write_texts(docs: DataFrame, column: str, folder: str, mode: str = "errorifexists") -> None:
    """One partition folder an image, one text file in it; refuses to overwrite unless told."""
    docs.select("image_id", F.col(column).alias("value")).write.mode(mode).partitionBy("image_id").text(folder)


def plan_json(plan: DataFrame) -> DataFrame:
    """(image_id, plan): all other columns as one JSON object."""
    return plan.select("image_id", F.to_json(F.struct(*(c for c in plan.columns if c != "image_id"))).alias("plan"))
