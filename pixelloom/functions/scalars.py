"""Geometry, text and layout scalars as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def odd(size: Column) -> Column:
    return F.when(size % 2 == 0, size + 1).otherwise(size)


def bleed_margin(width: Column, height: Column) -> Column:
    """Pixels by which a field that touches the frame extends beyond it."""
    return F.greatest(F.lit(3), F.rint(F.least(width, height) * 0.012).cast("int"))


def underlap(width: Column, height: Column, fraction: Column) -> Column:
    """struct<clearance, margin, field_kernel, occluder_kernel> of a seam; nothing for a fraction of 0 or less."""
    clear = F.greatest(F.lit(1), F.rint(F.least(width, height) * fraction).cast("int"))
    margin = F.greatest(F.lit(3), clear + 3)
    on = fraction > 0
    pick = lambda v, off: F.when(on, v).otherwise(F.lit(off))
    return F.struct(pick(clear, 0).alias("clearance"), pick(margin, 0).alias("margin"), pick((clear + margin) * 2 + 1, 1).alias("field_kernel"), pick(clear * 2 + 1, 1).alias("occluder_kernel"))


def gap_kernel(width: Column, height: Column, fraction: float) -> Column:
    return F.greatest(F.lit(3), odd(F.rint(F.least(width, height) * fraction).cast("int")))


def line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through a and b, from a itself if they are one point."""
    dx, dy = bx - ax, by - ay
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size == 0, F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))).otherwise(F.abs(dy * px - dx * py + bx * ay - by * ax) / size)


def centre_prior(x: Column, width: Column) -> Column:
    z = (x - width * 0.5) / F.greatest(F.lit(1.0), width * 0.2)
    return F.exp(-z * z)


def symmetry(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(F.lit(1e-9), F.greatest(a, b))


def compactness(area: Column, width: Column, height: Column) -> Column:
    return area / (width * height)


def aspect(width: Column, height: Column) -> Column:
    return F.least(width, height) / F.greatest(width, height)


def dimension(text: Column) -> Column:
    """Integer of `123` or `123px`, else null."""
    return F.when(text.rlike("^[0-9]+(px)?$"), F.regexp_extract(text, "^([0-9]+)", 1).cast("int"))


def path_bounds(path: Column) -> Column:
    """struct<x0, y0, x1, y1> of all numbers of a path, taken in turn as x and y; null if they don't pair."""
    numbers = F.transform(F.regexp_extract_all(path, F.lit(f"({_NUMBER})"), 1), lambda v: v.cast("double"))
    xs, ys = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
    ok = (F.size(numbers) >= 2) & (F.size(numbers) % 2 == 0)
    return F.when(ok, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def bleeds(bounds: Column, edges: Column, width: Column, height: Column) -> Column:
    """Whether the bounds go beyond every edge named in edges; without bounds only an empty list passes."""
    beyond = lambda e: (
        F.when(e == "left", bounds["x0"] < 0).when(e == "right", bounds["x1"] > width).when(e == "top", bounds["y0"] < 0).when(e == "bottom", bounds["y1"] > height).otherwise(F.lit(False))
    )
    return F.when(bounds.isNull(), F.size(edges) == 0).otherwise(F.forall(edges, beyond))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fixed(v: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", v)


def padded_id(n: Column, width: int = 3) -> Column:
    """A number with leading zeros; one that is longer stays whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def safe_name(n: Column, *parts: Column) -> Column:
    return F.concat_ws("-", padded_id(n), *parts)


def path_group(path: Column, groups: dict[str, str]) -> Column:
    """Slug of a path's first part, the part itself if it has none."""
    first = F.element_at(F.split(path, "/"), 1)
    out = first
    for part, slug in groups.items():
        out = F.when(first == part, slug).otherwise(out)
    return out


def is_comparison(path: Column, suffixes: list[str], terms: list[str]) -> Column:
    """An image in a folder `comparisons`, or with any of terms in its name."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    suffix = F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))
    named = F.lit(False)
    for t in terms:
        named = named | name.contains(t)
    return suffix.isin(suffixes) & (F.coalesce(F.try_element_at(parts, F.lit(-2)) == "comparisons", F.lit(False)) | named)


def shortened(text: Column, width: int = 62) -> Column:
    """Words joined by one space, as many as fit before an ellipsis."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    whole = F.array_join(words, " ")
    state = F.aggregate(
        words,
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, w: F.struct(
            F.when(~acc["full"] & (F.length(acc["s"]) + F.length(w) + F.when(acc["s"] == "", 0).otherwise(1) + 1 <= width), F.concat(acc["s"], F.when(acc["s"] == "", "").otherwise(" "), w)).otherwise(acc["s"]).alias("s"),
            (acc["full"] | (F.length(acc["s"]) + F.length(w) + F.when(acc["s"] == "", 0).otherwise(1) + 1 > width)).alias("full"),
        ),
    )
    return F.when(F.length(whole) <= width, whole).otherwise(F.concat(state["s"], F.lit("…")))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def ordered_replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def star_points(cx: Column, cy: Column, outer: Column, inner: Column, points: int = 16) -> Column:
    """Vertices of a star whose radii alternate, from the top on."""

    def vertex(i: Column) -> Column:
        angle = i * (2 * math.pi / points) - math.pi / 2
        radius = F.when(i % 2 == 0, outer).otherwise(inner)
        return F.struct((cx + radius * F.cos(angle)).alias("x"), (cy + radius * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), vertex)


def grid_place(i: Column, columns: int) -> Column:
    return F.struct(F.floor(i / columns).cast("int").alias("row"), (i % columns).cast("int").alias("col"))
