"""Joins that pixel analysis needs: nearest centre, neighbours, rings, overlapping ranges, lines, duplicates.

Tables of pixels and of components are merged, not broadcast: they are far smaller as Parquet, by which Spark would choose,
than in memory, and smaller still before their surroundings are exploded. Contacts and surroundings are found within an image,
by whose id both sides are dealt out first, so that only whole pixels are shuffled and not what they explode to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.masks import PIXEL
from pixelloom.operators.stencils import dilated

NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def nearest_centre(rows: DataFrame, values: list[str], centres: list[tuple[float, ...]], out: str = "label") -> DataFrame:
    """The index of the nearest of a few centres, the first of equally near ones: one projection, no join."""
    gaps = []
    for c in centres:
        parts = [(F.col(v) - m) * (F.col(v) - m) for v, m in zip(values, c, strict=True)]
        gaps.append(sum(parts[1:], parts[0]))
    return rows.withColumn("_d", F.array(*gaps)).withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def nearest_centre_of_image(rows: DataFrame, values: list[str], centres: DataFrame, out: str = "label") -> DataFrame:
    """As nearest_centre, with centres (image_id, label, values) that differ by image: they travel as one array each."""
    packed = centres.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", *values))).alias("_c"))

    def gap(c: Column) -> Column:
        parts = [(F.col(v) - c[v]) * (F.col(v) - c[v]) for v in values]
        return sum(parts[1:], parts[0])

    near = F.array_min(F.transform("_c", lambda c: F.struct(gap(c).alias("d"), c["label"].alias("label"))))
    return rows.join(packed, "image_id").withColumn(out, near["label"]).drop("_c")


def neighbours(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Each pixel with the columns of its four neighbours, as other_<name>: an equi-join on shifted places."""
    away = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS))).alias("d")
    sent = pixels.select("image_id", "y", "x", *(F.col(c).alias(f"other_{c}") for c in columns), away)
    sent = sent.select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), *(f"other_{c}" for c in columns))
    return pixels.join(sent.hint("merge"), PIXEL)


def by_image(pixels: DataFrame) -> DataFrame:
    """Pixels dealt out by image, as a side of a join that is merged."""
    return pixels.repartition("image_id").hint("merge")


def contacts(parts: DataFrame, owners: DataFrame) -> DataFrame:
    """(image_id, component, owner, contacts): sides that pixels of a component share with pixels of an owner."""
    away = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS))).alias("d")
    sent = by_image(parts.select(*PIXEL, "component")).select(*PIXEL, "component", away).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "component")
    return sent.join(by_image(owners.select(*PIXEL, "owner")), PIXEL).groupBy("image_id", "component", "owner").agg(F.count("*").alias("contacts"))


def near_contacts(parts: DataFrame, owners: DataFrame, frames: DataFrame, reach: int = 7, owner_reach: int = 5) -> DataFrame:
    """As contacts, for components that touch none: pixels in both surroundings."""
    around = dilated_by(parts, "component", reach, frames)
    near = dilated_by(owners, "owner", owner_reach, frames)
    return around.join(near.hint("merge"), PIXEL).groupBy("image_id", "component", "owner").agg(F.count("*").alias("contacts"))


def dilated_by(pixels: DataFrame, key: str, size: int, frames: DataFrame) -> DataFrame:
    k = size // 2
    along = lambda c, limit: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - k), F.least(F.col(limit) - 1, F.col(c) + k))).alias(c)
    rows = by_image(pixels.select(*PIXEL, key)).join(by_image(frames.select("image_id", "width", "height")), "image_id")
    rows = rows.where((F.col("x") + k >= 0) & (F.col("x") - k < F.col("width")) & (F.col("y") + k >= 0) & (F.col("y") - k < F.col("height")))
    out = rows.select("image_id", key, "y", "height", along("x", "width")).distinct()
    return out.select("image_id", along("y", "height"), "x", key).distinct()


def best_owner(found: DataFrame, distance: Column) -> DataFrame:
    """Of the owners of a component the one with most contacts for its colour distance, then most contacts, then the first."""
    score = F.col("contacts") / (distance * 2 + 1)
    w = Window.partitionBy("image_id", "component").orderBy(F.desc(score), F.desc("contacts"), "owner")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ring(parts: DataFrame, size: int, frames: DataFrame) -> DataFrame:
    """(pixel, component): the surroundings of each component without the component itself."""
    return dilated_by(parts, "component", size, frames).join(parts.select(*PIXEL, "component").hint("merge"), [*PIXEL, "component"], "left_anti")


def satellites(boxes: DataFrame, height: Column, gap: float = 0.045, cell: int = 64) -> DataFrame:
    """Pairs of boxes (image_id, component, x0, x1, y0, y1) where one lies above the other, with overlapping columns and at
    most a share of the height between them. Columns are cut into cells, so that the pairing is an equi-join."""
    cells = lambda c: F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias(c)
    low = boxes.select("*", cells("cell")).alias("m")
    high = boxes.select("*", cells("cell")).alias("s")
    overlap = F.least("m.x1", "s.x1") - F.greatest("m.x0", "s.x0") + 1
    between = F.col("m.y0") - F.col("s.y1") - 1
    met = low.join(high, (F.col("m.image_id") == F.col("s.image_id")) & (F.col("m.cell") == F.col("s.cell")) & (F.col("m.component") != F.col("s.component")) & (overlap > 0) & (between >= 0) & (between <= height * gap))
    met = met.where(F.col("m.cell") == F.floor(F.greatest("m.x0", "s.x0") / cell))  # only in the first cell they share
    return met.select("m.image_id", F.col("m.component").alias("main"), F.col("s.component").alias("satellite"), overlap.alias("overlap"), between.cast("int").alias("between"))


def along(lines: DataFrame, pixels: DataFrame, value: str, least: int = 8) -> DataFrame:
    """Mean of a value along segments (image_id, line, x0, y0, x1, y1), at about one sample a pixel."""
    n = F.greatest(F.lit(least), F.ceil(F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))).cast("int") + 1)
    spots = lines.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_t", F.col("_i") / (F.col("_n") - 1))
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("_t")).cast("int")
    spots = spots.select("image_id", "line", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))
    return spots.join(pixels.select(*PIXEL, value).hint("merge"), PIXEL).groupBy("image_id", "line").agg(F.avg(value).alias("mean"))


def spaced(points: DataFrame, distance: float | str, score: str) -> DataFrame:
    """Points (image_id, x, y, score) of which no two kept ones are closer than a distance, greedily by score: in each round
    a point is kept if nothing left within the distance beats it, and what it covers goes. Cells as wide as the distance
    make the comparison an equi-join of a point with nine cells. Each round decides the best of every neighbourhood, so the
    rounds end when no point is left."""
    from pixelloom.operators.components import stored

    distance = F.col(distance) if isinstance(distance, str) else F.lit(float(distance))  # a column holds one value an image
    rank = F.struct(F.col(score), -F.col("y"), -F.col("x"))
    left = stored(points.withColumn("_r", rank).withColumn("_cx", F.floor(F.col("x") / distance)).withColumn("_cy", F.floor(F.col("y") / distance)))
    kept = None
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("_d")
    while left.limit(1).count():
        sent = left.select("*", near).select("image_id", (F.col("_cx") + F.col("_d.a")).alias("_cx"), (F.col("_cy") + F.col("_d.b")).alias("_cy"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_r").alias("_o"))
        close = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) < distance * distance
        beaten = left.join(sent.hint("merge"), ["image_id", "_cx", "_cy"]).where(close & (F.col("_o") > F.col("_r"))).select("image_id", "y", "x").distinct()
        won = stored(left.join(beaten.hint("merge"), PIXEL, "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        cover = won.select("*", near).select("image_id", (F.col("_cx") + F.col("_d.a")).alias("_cx"), (F.col("_cy") + F.col("_d.b")).alias("_cy"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        gone = left.join(cover.hint("merge"), ["image_id", "_cx", "_cy"]).where(close).select("image_id", "y", "x").distinct()
        left = stored(left.join(gone.hint("merge"), PIXEL, "left_anti"))
    return (kept if kept is not None else left).select(*points.columns)


def first_of_content(rows: DataFrame, content: Column, id_col: str) -> DataFrame:
    """Adds digest and duplicate_of: the smallest id with the same content, null for that row itself. The smallest ids are
    aggregated before the shuffle, so very many copies of one content do not meet in one task."""
    rows = rows.withColumn("digest", F.sha2(content, 256))
    first = rows.groupBy("digest").agg(F.min(id_col).alias("_first"))
    return rows.join(first, "digest").withColumn("duplicate_of", F.when(F.col("_first") != F.col(id_col), F.col("_first"))).drop("_first")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def paired(one: DataFrame, two: DataFrame, key: str, path: str = "path", names: tuple[str, str] = ("source", "preview")) -> DataFrame:
    """(key, a path of each side, how many candidates each side has, status): files of two listings paired by id.

    Of several candidates the shortest path is taken, of equally long ones the first. status: paired, ambiguous if a side had
    several candidates, or <name>-only; a null id pairs with nothing and stands once for each row. Each side is aggregated
    before the join, so that very many candidates of one id never meet.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("_k"), F.col(path).cast("string").alias("_p"))
        best = F.min(F.struct(F.length("_p").alias("n"), F.col("_p").alias("p")))["p"]
        named = rows.where("_k is not null").groupBy("_k").agg(best.alias(name), F.count("*").alias(f"{name}_candidates"))
        return named, rows.where("_k is null").select(F.col("_k"), F.col("_p").alias(name), F.lit(1).cast("long").alias(f"{name}_candidates"))

    (left, stray), (right, other) = (side(df, name) for df, name in zip((one, two), names, strict=True))
    rows = left.join(right, "_k", "full").unionByName(stray, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    many = [F.coalesce(F.col(f"{n}_candidates"), F.lit(0)).alias(f"{n}_candidates") for n in names]
    status = F.when(F.col(f"{names[0]}_candidates").isNull(), f"{names[1]}-only").when(F.col(f"{names[1]}_candidates").isNull(), f"{names[0]}-only")
    status = status.when((F.col(f"{names[0]}_candidates") > 1) | (F.col(f"{names[1]}_candidates") > 1), "ambiguous").otherwise("paired")
    return rows.select(F.col("_k").alias(key), *names, *many, status.alias("status"))


def same_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, times, problem): what keeps rows from having each wanted id exactly once: missing, unknown or repeated."""
    have = rows.groupBy(key).agg(F.count("*").alias("times"))
    both = have.alias("h").join(wanted.select(key).distinct().withColumn("_w", F.lit(True)).alias("w"), F.col(f"h.{key}").eqNullSafe(F.col(f"w.{key}")), "full")
    problem = F.when(F.col("times").isNull(), "missing").when(F.col("_w").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    out = both.select(F.when(F.col("times").isNull(), F.col(f"w.{key}")).otherwise(F.col(f"h.{key}")).alias(key), F.coalesce("times", F.lit(0)).alias("times"), problem.alias("problem"))
    return out.where("problem is not null")


def assigned_twice(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def later_union(layers: DataFrame) -> DataFrame:
    """(image_id, ord, y, x): for each layer the pixels of all later ones. A pixel's greatest ord decides, so it is sent
    once to each earlier layer instead of once for each pair."""
    last = layers.groupBy(PIXEL).agg(F.max("ord").alias("last"))
    ords = layers.select("image_id", "ord").distinct()
    return last.join(ords, "image_id").where("ord < last").select("image_id", "ord", "y", "x")
