"""Registered queries over the given tables, each with the SQL that defines its result.

Rasters are derived from `embeddings`: 64 vectors make an image of 64 grey columns, or of 21 colour pixels, so the number
of images grows with the table. Every query covers whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import aggregates, detect, document, geometry, joins, masks, palette, regions, stencils, validate
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL
from pixelloom.plans.abstraction import abstraction
from pixelloom.plans.options import Options
from pixelloom.sources import raster

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared inputs
_GRAY = """gray AS (SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INT) AS y, CAST(i - 1 AS INT) AS x,
  CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 212.5) AS INT) AS v FROM embeddings, range(1, 65) t(i)),
frame AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM gray GROUP BY 1),
mask AS (SELECT image_id, y, x FROM gray WHERE v > 140), dark AS (SELECT image_id, y, x FROM gray WHERE v < 100),
label AS (SELECT image_id, y, x, v, CAST(CASE WHEN v <= 85 THEN 0 WHEN v <= 115 THEN 1 WHEN v <= 145 THEN 2 ELSE 3 END AS INT) AS label FROM gray)"""
_LEVEL = "CAST(floor((CAST(embedding[3 * x + {k}] AS DOUBLE) + 0.6) * 212.5) AS INT)"
_RGB = f"""rgb AS (SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INT) AS y, CAST(x AS INT) AS x, {_LEVEL.format(k=1)} AS r, {_LEVEL.format(k=2)} AS g, {_LEVEL.format(k=3)} AS b
  FROM embeddings, range(0, 21) t(x))"""
#: Centres of the grey labels: 70, 100, 130, 160; the nearest is the CASE above.
_LEVELS = [(70,), (100,), (130,), (160,)]
_ROLES = [(40, 60, 90), (100, 100, 100), (150, 140, 120), (190, 150, 110)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.gray_from_embeddings(_table(spark, sf_dir, "embeddings"))


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rgb_from_embeddings(_table(spark, sf_dir, "embeddings"))


def _frames(gray: DataFrame) -> DataFrame:
    return raster.frames(gray)


def _mask(gray: DataFrame) -> DataFrame:
    return masks.mask_where(gray, F.col("v") > 140)


def _dark(gray: DataFrame) -> DataFrame:
    return masks.mask_where(gray, F.col("v") < 100)


def _labels(gray: DataFrame) -> DataFrame:
    return joins.nearest_centre(gray, ["v"], _LEVELS)


def _round(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places) + 0.0


def registrar(queries: dict[str, Callable], sqls: dict[str, str]):
    """A decorator that registers a query, with the SQL that defines its result."""

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return register

    return query


query = registrar(_QUERIES, _SQL)


# ---------------------------------------------------------------- colour
@query(f"""WITH {_RGB}, d AS (SELECT *, [(r-40)*(r-40)+(g-60)*(g-60)+(b-90)*(b-90), (r-100)*(r-100)+(g-100)*(g-100)+(b-100)*(b-100), (r-150)*(r-150)+(g-140)*(g-140)+(b-120)*(b-120), (r-190)*(r-190)+(g-150)*(g-150)+(b-110)*(b-110)] AS d FROM rgb),
l AS (SELECT *, CAST(list_position(d, list_min(d)) - 1 AS INT) AS label FROM d)
SELECT image_id, label, CAST(round_even(median(r), 0) AS INT) AS r, CAST(round_even(median(g), 0) AS INT) AS g, CAST(round_even(median(b), 0) AS INT) AS b, count(*) AS population,
round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 6) AS fraction FROM l GROUP BY image_id, label""")
def palette_assign_summary(spark, sf_dir):
    rows = aggregates.median_color(joins.nearest_centre(_rgb(spark, sf_dir), ["r", "g", "b"], _ROLES), ["image_id", "label"])
    return rows.withColumn("fraction", F.round(F.col("population") / F.sum("population").over(Window.partitionBy("image_id")), 6))


@query(f"WITH {_RGB} SELECT printf('#%02X%02X%02X', r, g, b) AS swatch, count(*) AS pixels FROM rgb GROUP BY 1")
def rgb_hex_swatches(spark, sf_dir):
    return _rgb(spark, sf_dir).groupBy(color.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("swatch")).agg(F.count("*").alias("pixels"))


def _sql_linear(c: str) -> str:
    return f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END"


def _sql_dot(row, cols) -> str:
    return "(" + " + ".join(f"({w}::DOUBLE) * {c}" for w, c in zip(row, cols, strict=True)) + ")"


# The CSS Color 4 matrices, written again for the SQL.
_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
_BACK_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
_BACK_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
_LAB = (
    _RGB
    + f", lin AS (SELECT *, {', '.join(_sql_linear(c) + f' AS l{c}' for c in 'rgb')} FROM rgb), root AS (SELECT *, {', '.join(f'cbrt({_sql_dot(row, ["lr", "lg", "lb"])}) AS k{i}' for i, row in enumerate(_TO_LMS))} FROM lin), "
    + f"lab AS (SELECT image_id, y, x, r, g, b, {', '.join(f'{_sql_dot(row, ["k0", "k1", "k2"])} AS {n}' for n, row in zip(('L', 'a', 'bb'), _TO_LAB, strict=True))} FROM root)"
)


def _lab(spark, sf_dir) -> DataFrame:
    rows = _rgb(spark, sf_dir)
    return rows.select("*", *(c.alias(n) for c, n in zip(color.oklab(F.col("r"), F.col("g"), F.col("b")), ("L", "a", "bb"), strict=True)))


@query(f"WITH {_LAB} SELECT image_id, y, x, round(L, 6) + 0.0 AS light, round(a, 6) + 0.0 AS green_red, round(bb, 6) + 0.0 AS blue_yellow, round(sqrt(a*a + bb*bb), 6) AS chroma FROM lab")
def oklab_projection(spark, sf_dir):
    lab = [F.col(c) for c in ("L", "a", "bb")]
    return _lab(spark, sf_dir).select(*PIXEL, _round("L").alias("light"), _round("a").alias("green_red"), _round("bb").alias("blue_yellow"), F.round(color.chroma(lab), 6).alias("chroma"))


_SQL_BACK = (
    f"c AS (SELECT *, {', '.join(f'pow({_sql_dot(row, ["L", "a2", "b2"])}, 3) AS c{i}' for i, row in enumerate(_BACK_TO_LMS))} FROM s), "
    f"o AS (SELECT *, {', '.join(f'{_sql_dot(row, ["c0", "c1", "c2"])} AS o{i}' for i, row in enumerate(_BACK_TO_RGB))} FROM c)"
)


@query(
    f"WITH {_LAB}, s AS (SELECT image_id, L, a * 1.6 AS a2, bb * 1.6 AS b2 FROM lab), {_SQL_BACK} SELECT image_id, count(*) AS pixels, count(*) FILTER (least(o0, o1, o2) < -1e-5 OR greatest(o0, o1, o2) > 1.00001) AS outside FROM o GROUP BY 1"
)
def oklab_roundtrip_gamut(spark, sf_dir):
    strong = color.from_oklab([F.col("L"), F.col("a") * 1.6, F.col("bb") * 1.6])
    return _lab(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(strong.isNull()).alias("outside"))


@query(f"WITH {_RGB} SELECT image_id, y, x, r, g, b FROM rgb")
def oklab_roundtrip_exact(spark, sf_dir):
    back = color.from_oklab(color.oklab(F.col("r"), F.col("g"), F.col("b")))
    return _rgb(spark, sf_dir).select(*PIXEL, back.alias("c")).select(*PIXEL, "c.r", "c.g", "c.b")


@query(f"""WITH {_RGB}, h AS (SELECT image_id, max(y) + 1 AS height FROM rgb GROUP BY 1), j AS (SELECT *, 0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b AS lum, r - b AS warm FROM rgb JOIN h USING (image_id)),
s AS (SELECT image_id, avg(lum) FILTER (y < height * 0.58) AS top, quantile_cont(warm, 0.7) FILTER (y >= height * 0.45) AS low_warm, median(warm) FILTER (y < height * 0.58) AS top_warm FROM j GROUP BY 1)
SELECT image_id, round(top, 6) AS top_luminance, round(low_warm, 6) AS low_warmth, round(top_warm, 6) AS top_warmth, top < 82 AND low_warm > top_warm + 13 AS night FROM s""")
def luminance_warmth_gate(spark, sf_dir):
    rows = _rgb(spark, sf_dir)
    return detect.night_gate(rows).select("image_id", F.round("top", 6).alias("top_luminance"), F.round("low_warm", 6).alias("low_warmth"), F.round("top_warm", 6).alias("top_warmth"), "night")


@query(f"WITH {_RGB} SELECT image_id, y, round(sum(sqrt(pow((r-100)*0.30::DOUBLE, 2) + pow((g-100)*0.59::DOUBLE, 2) + pow((b-100)*0.11::DOUBLE, 2)) / 255.0), 6) AS distance FROM rgb GROUP BY 1, 2")
def weighted_color_distance(spark, sf_dir):
    gap = color.weighted_distance([F.col(c) for c in "rgb"], [F.lit(100)] * 3)
    return _rgb(spark, sf_dir).groupBy("image_id", "y").agg(F.round(F.sum(gap), 6).alias("distance"))


# ---------------------------------------------------------------- aggregates and windows
@query(f"WITH {_GRAY} SELECT image_id, {', '.join(f'round(quantile_cont(v, 0.{p}), 6) AS p{p}' for p in (18, 46, 54, 82))} FROM gray GROUP BY 1")
def quantile_stops(spark, sf_dir):
    return aggregates.stops(_gray(spark, sf_dir), "v").select("image_id", *(F.round(f"p{p}", 6).alias(f"p{p}") for p in (18, 46, 54, 82)))


@query(f"WITH {_GRAY}, m AS (SELECT image_id, y, median(v) AS m FROM gray GROUP BY 1, 2) SELECT image_id, y, x, v - m AS residual FROM gray JOIN m USING (image_id, y)")
def row_median_residual(spark, sf_dir):
    return aggregates.row_residual(_gray(spark, sf_dir), "v").select(*PIXEL, "residual")


@query(f"""WITH {_GRAY}, n AS (SELECT image_id, label, count(*) AS n FROM label GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p FROM n)
SELECT image_id, round(-sum(p * ln(p)) / ln(greatest(2, max(label) + 1)), 6) + 0.0 AS entropy FROM p GROUP BY 1""")
def label_histogram_entropy(spark, sf_dir):
    return aggregates.entropy(_labels(_gray(spark, sf_dir))).select("image_id", _round("entropy").alias("entropy"))


_GRADIENT = """gx AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS n, lag(v) OVER c AS u, lead(v) OVER c AS d FROM gray WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
grad AS (SELECT image_id, y, x, v, CASE WHEN l IS NULL THEN n - v WHEN n IS NULL THEN v - l ELSE (n - l) / 2.0::DOUBLE END AS dx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2.0::DOUBLE END AS dy FROM gx)"""


@query(f"WITH {_GRAY}, {_GRADIENT} SELECT image_id, y, x, round(sqrt(dx*dx + dy*dy), 6) AS gradient FROM grad")
def gradient_magnitude(spark, sf_dir):
    return stencils.gradient_magnitude(_gray(spark, sf_dir), "v").select(*PIXEL, F.round("gradient", 6).alias("gradient"))


@query(f"""WITH {_GRAY}, {_GRADIENT}, e AS (SELECT label.*, coalesce(label <> lag(label) OVER (PARTITION BY image_id, y ORDER BY x), false) OR coalesce(label <> lag(label) OVER (PARTITION BY image_id, x ORDER BY y), false) AS edge FROM label),
q AS (SELECT g.image_id, CAST(g.y >= height // 2 AS INT) * 2 + CAST(g.x >= width // 2 AS INT) AS quadrant, sqrt(dx*dx + dy*dy) AS g, edge FROM grad g JOIN e USING (image_id, y, x) JOIN frame USING (image_id)),
l AS (SELECT image_id, quadrant, quantile_cont(g, 0.88) AS lim FROM q GROUP BY 1, 2)
SELECT image_id, quadrant, round(sum(CASE WHEN g >= lim AND edge THEN g ELSE 0 END) / greatest(sum(CASE WHEN g >= lim THEN g ELSE 0 END), 1e-9), 6) AS recall FROM q JOIN l USING (image_id, quadrant) GROUP BY 1, 2""")
def quadrant_stats(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    rows = stencils.boundaries(stencils.gradient_magnitude(_labels(gray), "v"), "label")
    rows = aggregates.quadrants(rows.join(_frames(gray), "image_id"))
    return aggregates.edge_recall(rows, ["image_id", "quadrant"], "gradient", "boundary").select("image_id", "quadrant", F.round("recall", 6).alias("recall"))


@query(f"""WITH {_GRAY}, e AS (SELECT image_id, label, CAST(y < d AS INT) + CAST(x < d AS INT) + CAST(x >= width - d AS INT) AS times FROM label JOIN (SELECT *, greatest(1, CAST(round_even(least(width, height) * 0.035, 0) AS INT)) AS d FROM frame) USING (image_id)),
n AS (SELECT image_id, label, sum(times) AS n FROM e WHERE times > 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM n) SELECT image_id, label AS background FROM k WHERE k = 1""")
def edge_mode_background(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return aggregates.edge_mode(_labels(gray), _frames(gray))


@query(f"""WITH {_GRAY}, n AS (SELECT image_id, label, count(*) AS n FROM label GROUP BY 1, 2), f AS (SELECT image_id, label, round(n / sum(n) OVER (PARTITION BY image_id), 6) AS fraction FROM n),
m AS (SELECT *, max(label) OVER (PARTITION BY image_id) AS last FROM f) SELECT image_id, label, CASE WHEN label = last THEN round(1.0 - coalesce(sum(CASE WHEN label <> last THEN fraction END) OVER (PARTITION BY image_id), 0), 6) ELSE fraction END AS fraction FROM m""")
def fraction_reconcile(spark, sf_dir):
    return aggregates.reconciled(aggregates.populations(_labels(_gray(spark, sf_dir))).select("image_id", "label", "fraction"), "label")


@query(f"""WITH {_GRAY}, a AS (SELECT image_id, axis FROM frame, range(20, 45) t(axis) WHERE axis < height), u AS (SELECT g.image_id, axis, y, x, v FROM gray g JOIN a USING (image_id)),
p AS (SELECT t.image_id, t.axis, t.v AS a, m.v AS b FROM u t JOIN u m ON t.image_id = m.image_id AND t.axis = m.axis AND t.x = m.x AND t.y < t.axis AND m.y >= m.axis AND t.y = 2 * t.axis - 1 - m.y)
SELECT image_id, axis, round((avg(a * b) - avg(a) * avg(b)) / (greatest(stddev_pop(a), 1e-6) * greatest(stddev_pop(b), 1e-6)), 6) + 0.0 AS correlation FROM p GROUP BY 1, 2""")
def mirror_correlation(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    axes = _frames(gray).select("image_id", "height", F.explode(F.sequence(F.lit(20).cast("long"), F.lit(44).cast("long"))).alias("axis")).where("axis < height").drop("height")
    return aggregates.mirror_correlation(gray, "v", axes).select("image_id", "axis", _round("correlation").alias("correlation"))


@query(f"""WITH {_GRAY}, d AS (SELECT image_id, y, abs(v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y)) AS d FROM gray), r AS (SELECT image_id, y, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY 1, 2)
SELECT image_id, y, CAST(m AS DOUBLE) AS delta, m >= quantile_cont(m, 0.72) OVER (PARTITION BY image_id) AS strong FROM r""")
def vertical_delta_p72(spark, sf_dir):
    rows = stencils.vertical_delta(_gray(spark, sf_dir), ["v"]).where("delta is not null").groupBy("image_id", "y").agg(F.median("delta").alias("delta"))
    return rows.withColumn("strong", F.col("delta") >= F.percentile("delta", F.lit(0.72)).over(Window.partitionBy("image_id")))


@query(f"""WITH {_GRAY}, e AS (SELECT image_id, y, label, coalesce(label <> lag(label) OVER (PARTITION BY image_id, y ORDER BY x), false) OR coalesce(label <> lag(label) OVER (PARTITION BY image_id, x ORDER BY y), false) AS edge FROM label)
SELECT image_id, y, count(*) FILTER (edge) AS edges FROM e GROUP BY 1, 2""")
def label_boundary(spark, sf_dir):
    return stencils.boundaries(_labels(_gray(spark, sf_dir)), "label").groupBy("image_id", "y").agg(F.count_if("boundary").alias("edges"))


@query(f"""WITH {_GRAY}, s AS (SELECT g.image_id, g.y, g.x, g.v, o.v AS o FROM gray g, range(-7, 8) t(d) JOIN gray o ON o.image_id = g.image_id AND o.y = g.y AND o.x = CASE WHEN abs(g.x + d) > 63 THEN 126 - abs(g.x + d) ELSE abs(g.x + d) END)
SELECT image_id, y, x, round(v - avg(o), 6) + 0.0 AS contrast FROM s GROUP BY image_id, y, x, v""")
def box_mean_contrast(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    radius = F.greatest(F.lit(4), F.floor(F.count("*") * 0.12).cast("int"))
    means = stencils.reflected_mean(gray, "v", radius, "mean")
    return gray.join(means, PIXEL).select(*PIXEL, _round(F.col("v") - F.col("mean")).alias("contrast"))


def _sql_convolve(table: str, axis: str, radius: float) -> str:
    """A Gaussian of a radius, cut at three of them, that sums to one; ends extended."""
    part, order = ("image_id, y", "x") if axis == "x" else ("image_id, x", "y")
    reach = -int(-3 * radius // 1)
    first, last = (f"{f}(v) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for f in ("first_value", "last_value"))
    bell = [f"exp(-0.5::DOUBLE * pow({d} / {radius}::DOUBLE, 2))" for d in range(reach + 1)]
    terms = ["v"] + [f"(coalesce(lag(v, {d}) OVER w, {first}) + coalesce(lead(v, {d}) OVER w, {last})) * {bell[d]}" for d in range(1, reach + 1)]
    return f"SELECT image_id, y, x, ({' + '.join(terms)}) / (1 + 2 * ({' + '.join(bell[1:])})) AS v FROM {table} WINDOW w AS (PARTITION BY {part} ORDER BY {order})"


@query(f"WITH {_GRAY}, a AS ({_sql_convolve('gray', 'x', 1.4)}), b AS ({_sql_convolve('a', 'y', 1.4)}) SELECT image_id, y, x, round(v, 6) AS soft FROM b")
def gaussian_separable(spark, sf_dir):
    return stencils.gaussian(_gray(spark, sf_dir), "v", 1.4, "soft").select(*PIXEL, F.round("soft", 6).alias("soft"))


@query(f"WITH {_GRAY}, a AS ({_sql_convolve('gray', 'x', 2.3)}), b AS ({_sql_convolve('a', 'y', 2.3)}) SELECT g.image_id, y, x, round(g.v - b.v, 6) + 0.0 AS detail FROM gray g JOIN b USING (image_id, y, x)")
def high_pass_detail(spark, sf_dir):
    return stencils.high_pass(_gray(spark, sf_dir), "v").select(*PIXEL, _round("detail").alias("detail"))


@query(f"""WITH {_GRAY}, b AS (SELECT image_id, y, x, avg(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING) - avg(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) AS c FROM gray)
SELECT image_id, y, x, round(c, 6) + 0.0 AS contrast FROM b WHERE c IS NOT NULL""")
def band_contrast(spark, sf_dir):
    return stencils.band_contrast(_gray(spark, sf_dir), "v").where("contrast is not null").select(*PIXEL, _round("contrast").alias("contrast"))


@query(f"""WITH {_GRAY}, s AS (SELECT image_id, x, avg(v) AS v FROM gray GROUP BY 1, 2), l AS (SELECT *, min(v) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS low FROM s)
SELECT image_id, x, round(v * 0.35 + max(low) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) * 0.65, 6) AS envelope FROM l""")
def opening_envelope(spark, sf_dir):
    series = _gray(spark, sf_dir).groupBy("image_id", "x").agg(F.avg("v").alias("v"))
    return stencils.envelope(series, "v", 9).select("image_id", "x", F.round("envelope", 6).alias("envelope"))


# ---------------------------------------------------------------- morphology and masks
def _sql_extreme(f: str) -> str:
    return f"""WITH {_GRAY}, a AS (SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM gray)
SELECT image_id, y, x, {f}(v) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM a"""


@query(_sql_extreme("max"))
def dilate(spark, sf_dir):
    return stencils.extreme(_gray(spark, sf_dir), "v", 5, "max")


@query(_sql_extreme("min"))
def erode(spark, sf_dir):
    return stencils.extreme(_gray(spark, sf_dir), "v", 5, "min")


def _sql_dilated(mask: str, k: int) -> str:
    return f"SELECT DISTINCT f.image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x FROM {mask}, range(-{k}, {k + 1}) a(dy), range(-{k}, {k + 1}) b(dx)) m JOIN frame f USING (image_id) WHERE x >= 0 AND y >= 0 AND x < width AND y < height"


def _sql_eroded(mask: str, k: int) -> str:
    return f"SELECT image_id, y, x FROM {mask} EXCEPT SELECT image_id, y + dy, x + dx FROM (SELECT image_id, y, x FROM gray EXCEPT SELECT image_id, y, x FROM {mask}) u, range(-{k}, {k + 1}) a(dy), range(-{k}, {k + 1}) b(dx)"


def _cast(select: str) -> str:
    return f"SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM ({select})"


_CLOSED = f"grown AS ({_sql_dilated('mask', 1)}), closed AS ({_cast(_sql_eroded('grown', 1))})"


@query(f"WITH {_GRAY}, {_CLOSED} SELECT * FROM closed")
def mask_close(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.closed(_mask(gray), 3, _frames(gray))


@query(f"WITH {_GRAY}, shrunk AS ({_sql_eroded('dark', 1)}), opened AS ({_cast(_sql_dilated('shrunk', 1))}) SELECT * FROM opened")
def mask_open(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.opened(_dark(gray), 3, _frames(gray))


@query(f"WITH {_GRAY}, {_CLOSED} SELECT image_id, count(*) AS pixels, count(*) FILTER ((image_id, y, x) NOT IN (SELECT (image_id, y, x) FROM mask)) AS added FROM (SELECT * FROM closed UNION SELECT * FROM mask) GROUP BY 1")
def additive_gap_close(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.gap_closed(_mask(gray), 3, _frames(gray)).groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if("added").alias("added"))


@query(f"""WITH {_GRAY}, n AS (SELECT l.image_id, y + dy AS y, x + dx AS x, label, count(*) AS n FROM label l, range(-1, 2) a(dy), range(-1, 2) b(dx) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY n DESC, label) AS k FROM n) SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, label FROM k JOIN frame USING (image_id) WHERE k = 1 AND x >= 0 AND y >= 0 AND x < width AND y < height""")
def mode_filter(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.mode(_labels(gray), "label", 3, _frames(gray))


@query(f"WITH {_GRAY}, f AS ({_sql_dilated('mask', 5)}), o AS ({_sql_dilated('dark', 1)}) {_cast('SELECT * FROM f INTERSECT SELECT * FROM o EXCEPT SELECT * FROM mask')}")
def seam_overlap(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.seam_overlap(_mask(gray), _dark(gray), 1, 4, _frames(gray))


@query(f"WITH {_GRAY} SELECT * FROM mask UNION SELECT * FROM dark")
def mask_union(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.union(_mask(gray), _dark(gray))


@query(f"WITH {_GRAY}, even AS (SELECT image_id, y, x FROM gray WHERE v % 2 = 0) SELECT * FROM mask INTERSECT SELECT * FROM even")
def mask_intersect(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.intersection(_mask(gray), masks.mask_where(gray, F.col("v") % 2 == 0))


@query(f"WITH {_GRAY}, even AS (SELECT image_id, y, x FROM gray WHERE v % 2 = 0) SELECT * FROM mask EXCEPT SELECT * FROM even")
def mask_except(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.difference(_mask(gray), masks.mask_where(gray, F.col("v") % 2 == 0))


@query(f"WITH {_GRAY} SELECT image_id, y, x FROM gray EXCEPT SELECT * FROM mask")
def mask_complement(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.complement(_mask(gray), _frames(gray))


@query(f"WITH {_GRAY}, q AS (SELECT image_id, greatest(150.0, quantile_cont(v, 0.9)) AS lim FROM gray GROUP BY 1) SELECT image_id, y, x FROM gray JOIN q USING (image_id) WHERE v >= lim")
def percentile_threshold(spark, sf_dir):
    return masks.above_percentile(_gray(spark, sf_dir), "v", 0.9, 150)


@query(f"""WITH {_GRAY}, layers AS (SELECT *, 0 AS p FROM mask UNION ALL SELECT image_id, y, x, 1 FROM gray WHERE v % 3 = 0 UNION ALL SELECT *, 2 FROM dark), c AS (SELECT image_id, y, x, min(p) AS p FROM layers GROUP BY ALL),
keep AS (SELECT image_id, p FROM (SELECT image_id, p, count(*) AS n FROM c GROUP BY ALL) JOIN frame USING (image_id) WHERE n >= greatest(16, width * height * 0.003))
SELECT l.image_id, l.y, l.x, CAST(coalesce(k.p + 4, l.label) AS INT) AS label FROM label l LEFT JOIN (SELECT c.* FROM c JOIN keep USING (image_id, p)) k USING (image_id, y, x)""")
def priority_claim(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    layers = _mask(gray).withColumn("priority", F.lit(0)).unionByName(masks.mask_where(gray, F.col("v") % 3 == 0).withColumn("priority", F.lit(1))).unionByName(_dark(gray).withColumn("priority", F.lit(2)))
    claims = masks.claimed(layers, _frames(gray))
    return masks.overwritten(_labels(gray).select(*PIXEL, "label"), claims, offset=4)


@query(f"""WITH {_GRAY}, e AS (SELECT image_id, bool_or(x = 0) AS l, bool_or(x = width - 1) AS r, bool_or(y = 0) AS t, bool_or(y = height - 1) AS b FROM mask JOIN frame USING (image_id) GROUP BY 1)
SELECT image_id, concat_ws(',', CASE WHEN l THEN 'left' END, CASE WHEN r THEN 'right' END, CASE WHEN t THEN 'top' END, CASE WHEN b THEN 'bottom' END) AS edges FROM e""")
def touched_edges(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.touched_edges(_mask(gray), _frames(gray)).select("image_id", F.array_join("edges", ",").alias("edges"))


# ---------------------------------------------------------------- components
def _sql_reach(name: str, cells: str, same: str = "") -> str:
    """Components by recursion: UNION keeps each (pixel, root) once."""
    on = "abs(m.y - r.y) + abs(m.x - r.x) = 1" + (f" AND m.{same} = r.{same}" if same else "")
    keep, take = (f", {same}", f", m.{same}") if same else ("", "")
    return f"""{name}_r AS (SELECT image_id, y, x{keep}, y::BIGINT * 1048576 + x AS root FROM {cells} UNION SELECT m.image_id, m.y, m.x{take}, r.root FROM {name}_r r JOIN {cells} m ON m.image_id = r.image_id AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1 AND {on}),
{name} AS (SELECT image_id, y, x{keep}, min(root) AS component FROM {name}_r GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')} SELECT image_id, component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM c GROUP BY 1, 2")
def connected_components(spark, sf_dir):
    found = K.measures(K.components(_mask(_gray(spark, sf_dir))))
    return found.select("image_id", "component", "area", "x0", "y0", "x1", "y1", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"""WITH RECURSIVE {_GRAY}, bright AS (SELECT image_id, y, x, label FROM label WHERE label >= 2), {_sql_reach('c', 'bright', 'label')}, n AS (SELECT image_id, component, label, count(*) AS area FROM c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, component) AS rank FROM n) SELECT image_id, label, component, area, rank FROM k WHERE rank <= 5""")
def label_components_topk(spark, sf_dir):
    parts = K.components(_labels(_gray(spark, sf_dir)).where("label >= 2"), "label")
    n = parts.groupBy("image_id", "component", "label").agg(F.count("*").alias("area"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "component")).cast("long")
    return n.withColumn("rank", rank).where("rank <= 5").select("image_id", "label", "component", "area", "rank")


@query(f"""WITH RECURSIVE {_GRAY}, cells AS (SELECT * FROM mask UNION SELECT g.image_id, y, x FROM gray g JOIN frame USING (image_id) WHERE y = height - 1),
flood AS (SELECT c.image_id, y, x FROM cells c JOIN frame USING (image_id) WHERE y = height - 1 UNION SELECT c.image_id, c.y, c.x FROM flood f JOIN cells c ON c.image_id = f.image_id AND abs(c.y - f.y) + abs(c.x - f.x) = 1) SELECT * FROM flood""")
def bottom_connected(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.bottom_connected(_mask(gray), _frames(gray))


_HOLES = f"""open AS (SELECT image_id, y, x FROM gray EXCEPT SELECT * FROM wide), air AS (SELECT o.* FROM open o JOIN frame USING (image_id) WHERE x = 0 OR y = 0 OR x = width - 1 OR y = height - 1
UNION SELECT o.image_id, o.y, o.x FROM air a JOIN open o ON o.image_id = a.image_id AND abs(o.y - a.y) + abs(o.x - a.x) = 1), hole AS (SELECT * FROM open EXCEPT SELECT * FROM air)"""
_WIDE = "wide AS (SELECT image_id, y, x FROM gray WHERE v > 112)"


def _wide(gray: DataFrame) -> DataFrame:
    return masks.mask_where(gray, F.col("v") > 112)


@query(f"WITH RECURSIVE {_GRAY}, {_WIDE}, {_HOLES} SELECT * FROM hole")
def enclosed_holes(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.holes(_wide(gray), _frames(gray)).select(PIXEL)


@query(f"WITH RECURSIVE {_GRAY}, {_WIDE}, {_HOLES}, {_sql_reach('c', 'hole')}, s AS (SELECT image_id, component FROM c GROUP BY ALL HAVING count(*) <= 2) SELECT * FROM wide UNION ALL SELECT c.image_id, y, x FROM c JOIN s USING (image_id, component)")
def small_holes_filled(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.filled(_wide(gray), _frames(gray), most=2)


@query(f"""WITH RECURSIVE {_GRAY}, {_WIDE}, open AS (SELECT image_id, y, x FROM gray EXCEPT SELECT * FROM wide), sky AS (SELECT * FROM open WHERE y = 0 UNION SELECT o.image_id, o.y, o.x FROM sky a JOIN open o ON o.image_id = a.image_id AND abs(o.y - a.y) + abs(o.x - a.x) = 1)
SELECT image_id, y, x FROM gray EXCEPT SELECT * FROM sky""")
def sky_fill(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.below_sky(_wide(gray), _frames(gray))


@query(f"""WITH RECURSIVE {_GRAY}, cells AS (SELECT image_id, y, x, label FROM label), {_sql_reach('c', 'cells', 'label')}, n AS (SELECT image_id, label, component, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT image_id, label, max(n) AS m, sum(n) AS s FROM n GROUP BY 1, 2)
SELECT image_id, round(sum(m) / sum(s), 6) AS coherence FROM b GROUP BY 1""")
def component_coherence(spark, sf_dir):
    return K.coherence(K.components(_labels(_gray(spark, sf_dir)), "label"), "label").select("image_id", F.round("coherence", 6).alias("coherence"))


@query(f"""WITH RECURSIVE {_GRAY}, domain AS (SELECT image_id, y, x FROM gray WHERE v > 118), g AS (SELECT image_id, y, x, 0 AS step FROM mask UNION SELECT d.image_id, d.y, d.x, g.step + 1 FROM g JOIN domain d ON d.image_id = g.image_id AND abs(d.y - g.y) <= 1 AND abs(d.x - g.x) <= 1 WHERE g.step < 3)
SELECT DISTINCT image_id, y, x FROM g""")
def constrained_growth(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.grown(_mask(gray), masks.mask_where(gray, F.col("v") > 118), _frames(gray), rounds=3)


_PARTS = "big AS (SELECT image_id, component, label, count(*) AS area, avg(y) AS cy FROM c GROUP BY ALL)"
_COLORS = "CASE label WHEN 0 THEN 70 WHEN 1 THEN 100 WHEN 2 THEN 130 ELSE 160 END"


def _palette_rows(frames: DataFrame) -> DataFrame:
    grey = F.array(*(F.lit(v[0]) for v in _LEVELS))
    return frames.select("image_id", F.posexplode(grey).alias("label", "r")).select("image_id", "label", "r", F.col("r").alias("g"), F.col("r").alias("b"))


@query(f"""WITH RECURSIVE {_GRAY}, cells AS (SELECT image_id, y, x, label FROM label WHERE label <> 1), {_sql_reach('c', 'cells', 'label')}, {_PARTS},
s AS (SELECT *, area / (width * height) * (0.55 + 1.8 * sqrt(pow(({_COLORS} - 100) * 0.30, 2) + pow(({_COLORS} - 100) * 0.59, 2) + pow(({_COLORS} - 100) * 0.11, 2)) / 255.0) AS score FROM big JOIN frame USING (image_id) WHERE area >= width * height * 0.004),
m AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY area DESC, component) = 1 AS first FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY first DESC, CASE WHEN first THEN label END, score DESC, component) AS n FROM m)
SELECT image_id, component, label, area, round(score, 6) AS score, row_number() OVER (PARTITION BY image_id ORDER BY cy, area DESC, component) AS paint FROM t WHERE n <= 6""")
def region_budget_select(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    frames = _frames(gray)
    parts = K.components(_labels(gray).where("label <> 1"), "label")
    found = regions.scored(parts, frames, _palette_rows(frames), frames.select("image_id", F.lit(1).alias("background")), detail=1.0)
    return regions.within_budget(found, 6).select("image_id", "component", "label", "area", F.round("score", 6).alias("score"), F.col("paint").cast("long").alias("paint"))


@query(f"""WITH RECURSIVE {_GRAY}, cells AS (SELECT image_id, y, x, label FROM label WHERE label <> 1), {_sql_reach('c', 'cells', 'label')}, {_PARTS}, owner AS (SELECT c.* FROM c JOIN big USING (image_id, component) WHERE area >= 12),
lost AS (SELECT c.* FROM c JOIN big USING (image_id, component) WHERE area < 12), t AS (SELECT l.image_id, l.component, l.label, o.component AS owner, o.label AS olabel, count(*) AS contacts FROM lost l JOIN owner o ON l.image_id = o.image_id AND abs(l.y - o.y) + abs(l.x - o.x) = 1 GROUP BY ALL),
s AS (SELECT *, contacts / (1 + 2 * sqrt(pow((({_COLORS}) - ({_COLORS.replace('label', 'olabel')})) * 0.30, 2) + pow((({_COLORS}) - ({_COLORS.replace('label', 'olabel')})) * 0.59, 2) + pow((({_COLORS}) - ({_COLORS.replace('label', 'olabel')})) * 0.11, 2)) / 255.0) AS score FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, component ORDER BY score DESC, contacts DESC, owner) AS k FROM s) SELECT image_id, component, owner, contacts FROM k WHERE k = 1""")
def adjacency_owner_merge(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    parts = K.stored(K.components(_labels(gray).where("label <> 1"), "label"))
    size = parts.groupBy("image_id", "component").agg(F.count("*").alias("area"))
    owner = parts.join(size.where("area >= 12"), ["image_id", "component"]).select(*PIXEL, "label", F.col("component").alias("owner"))
    lost = parts.join(size.where("area < 12"), ["image_id", "component"]).select(*PIXEL, "label", "component")
    touch = joins.contacts(lost, owner)
    grey = lambda c: F.element_at(F.array(*(F.lit(v[0]) for v in _LEVELS)), F.col(c) + 1)
    rows = touch.join(lost.select("image_id", "component", "label").distinct(), ["image_id", "component"]).join(owner.select("image_id", "owner", F.col("label").alias("olabel")).distinct(), ["image_id", "owner"])
    return joins.best_owner(rows, color.weighted_distance([grey("label")] * 3, [grey("olabel")] * 3)).select("image_id", "component", "owner", "contacts")


@query(f"""WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')}, w AS (SELECT DISTINCT c.image_id, component, y + dy AS y, x + dx AS x FROM c, range(-2, 3) a(dy), range(-2, 3) b(dx)), ring AS (SELECT w.* FROM w ANTI JOIN c USING (image_id, component, y, x)),
n AS (SELECT image_id, component, label, count(*) AS n FROM ring JOIN label USING (image_id, y, x) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, component ORDER BY n DESC, label) AS k FROM n)
SELECT image_id, component, round(max(n) / sum(n), 6) AS purity, CAST(max(label) FILTER (k = 1) AS INT) AS top FROM k GROUP BY 1, 2""")
def ring_purity(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    around = joins.ring(K.stored(K.components(_mask(gray))), 5, _frames(gray)).join(_labels(gray).select(*PIXEL, "label"), PIXEL)
    return aggregates.purity(around, "label", ["image_id", "component"]).select("image_id", "component", F.round("purity", 6).alias("purity"), "top")


@query(f"""WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')}, box AS (SELECT image_id, component, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY 1, 2)
SELECT m.image_id, m.component AS main, s.component AS satellite, least(m.x1, s.x1) - greatest(m.x0, s.x0) + 1 AS overlap, m.y0 - s.y1 - 1 AS between FROM box m JOIN box s ON m.image_id = s.image_id AND m.component <> s.component AND least(m.x1, s.x1) - greatest(m.x0, s.x0) + 1 > 0 AND m.y0 - s.y1 - 1 BETWEEN 0 AND 64 * 0.045""")
def satellite_range_join(spark, sf_dir):
    return joins.satellites(K.measures(K.components(_mask(_gray(spark, sf_dir)))), F.lit(64), cell=8)


@query(f"""WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')}, e AS (SELECT c.*, dy, dx, p, q, s, t FROM c, (VALUES (-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0)) v(dy, dx, p, q, s, t))
SELECT e.image_id, e.component, e.x + p AS ax, e.y + q AS ay, e.x + s AS bx, e.y + t AS by FROM e ANTI JOIN c ON c.image_id = e.image_id AND c.component = e.component AND c.y = e.y + dy AND c.x = e.x + dx""")
def boundary_edges(spark, sf_dir):
    return regions.boundary_edges(K.stored(K.components(_mask(_gray(spark, sf_dir)))))


@query(f"""WITH {_GRAY}, l AS (SELECT image_id, i AS line, 0 AS x0, CAST(i AS INT) AS y0, 63 AS x1, CAST(height - 1 - i AS INT) AS y1 FROM frame, range(0, 64, 7) t(i) WHERE i < height),
n AS (SELECT *, greatest(8, CAST(ceil(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS INT) + 1) AS n FROM l), s AS (SELECT *, i / (n - 1) AS t FROM n, range(0, 200) r(i) WHERE i < n),
p AS (SELECT image_id, line, CAST(round_even(x0 + (x1 - x0) * t, 0) AS INT) AS x, CAST(round_even(y0 + (y1 - y0) * t, 0) AS INT) AS y FROM s) SELECT image_id, line, round(avg(v), 6) AS mean FROM p JOIN gray USING (image_id, y, x) GROUP BY 1, 2""")
def line_integral(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    lines = _frames(gray).select("image_id", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"), F.lit(7).cast("long"))).alias("line")).where("line < height")
    lines = lines.select("image_id", "line", F.lit(0).alias("x0"), F.col("line").cast("int").alias("y0"), F.lit(63).alias("x1"), (F.col("height") - 1 - F.col("line")).cast("int").alias("y1"))
    return joins.along(lines, gray, "v").select("image_id", "line", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_GRAY}, p AS (SELECT image_id, y, avg(x) AS c FROM mask GROUP BY 1, 2), f AS (SELECT image_id, regr_slope(c, y) AS s, regr_intercept(c, y) AS i FROM p GROUP BY 1)
SELECT image_id, round(s, 6) + 0.0 AS slope, round(i, 6) + 0.0 AS intercept, round(median(abs(c - s * y - i)), 6) AS error FROM p JOIN f USING (image_id) WHERE s IS NOT NULL GROUP BY image_id, s, i""")
def row_regression(spark, sf_dir):
    centres = _mask(_gray(spark, sf_dir)).groupBy("image_id", "y").agg(F.avg("x").alias("c"))
    return aggregates.line_fit(centres, ["image_id"], "y", "c").where("slope is not null").select("image_id", _round("slope").alias("slope"), _round("intercept").alias("intercept"), F.round("error", 6).alias("error"))


@query(f"WITH {_GRAY}, r AS (SELECT image_id, x, y, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS g FROM mask) SELECT image_id, x, min(y) AS first, max(y) AS last, count(*) AS size FROM r GROUP BY image_id, x, g HAVING count(*) >= 3")
def column_runs(spark, sf_dir):
    return aggregates.islands(_mask(_gray(spark, sf_dir)), ["image_id", "x"], "y")


@query(f"""WITH {_GRAY}, d AS (SELECT l.image_id, l.y, l.x, l.v, count(*) AS neighbours, count(*) FILTER (o.label <> l.label) AS other FROM label l JOIN label o ON l.image_id = o.image_id AND abs(l.y - o.y) + abs(l.x - o.x) = 1 AND o.y BETWEEN l.y - 1 AND l.y + 1 GROUP BY ALL)
SELECT image_id, y, x, neighbours, other FROM d""")
def neighbour_join(spark, sf_dir):
    found = joins.neighbours(_labels(_gray(spark, sf_dir)), ["label"])
    return found.groupBy(PIXEL).agg(F.count("*").alias("neighbours"), F.count_if(F.col("label") != F.col("other_label")).alias("other"))


# ---------------------------------------------------------------- outlines of event series
_EV = "ev AS (SELECT user_id, event_id, CAST(epoch(ts) AS DOUBLE) - min(CAST(epoch(ts) AS DOUBLE)) OVER (PARTITION BY user_id) AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _series(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.select("user_id", "event_id", (at - F.min(at).over(Window.partitionBy("user_id"))).alias("x"), F.col("value").alias("y"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("i"))


@query(f"""WITH {_EV}, s AS (SELECT user_id, i, sqrt(pow(coalesce(lead(x) OVER w, first_value(x) OVER w) - x, 2) + pow(coalesce(lead(y) OVER w, first_value(y) OVER w) - y, 2)) AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(step, 3) AS step, round(sum(step) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) - step, 3) + 0.0 AS along FROM s""")
def arc_length_prefix(spark, sf_dir):
    return geometry.arc_lengths(_series(spark, sf_dir), ["user_id"], ["i"]).select("user_id", "i", F.round("step", 3).alias("step"), _round("along", 3).alias("along"))


def _sql_low_pass(table: str, strength: str) -> str:
    near = lambda k, c: f"(SELECT {c} FROM {table} o WHERE o.user_id = e.user_id AND o.i = ((e.i + {k}) % e.n + e.n) % e.n)"
    blur = lambda c: f"({near(-2, c)} + {near(-1, c)} * 4.0::DOUBLE + {c} * 6.0::DOUBLE + {near(1, c)} * 4.0::DOUBLE + {near(2, c)}) / 16.0::DOUBLE"
    return f"SELECT user_id, i, n, {', '.join(f'{c} * (1.0 - {strength}) + {blur(c)} * {strength} AS {c}' for c in 'xy')} FROM {table} e"


@query(f"WITH {_EV}, a AS ({_sql_low_pass('ev', '0.2574::DOUBLE')}), b AS ({_sql_low_pass('a', '0.2574::DOUBLE')}) SELECT user_id, i, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM b")
def closed_low_pass(spark, sf_dir):
    return geometry.low_passed(_series(spark, sf_dir), ["user_id"], ["i"]).select("user_id", "i", _round("x", 3).alias("x"), _round("y", 3).alias("y"))


# ---------------------------------------------------------------- catalogues and texts
@query("SELECT doc_id, sha256(text) AS digest, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def duplicate_content(spark, sf_dir):
    return joins.first_of_content(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "digest", "duplicate_of")


@query("SELECT source, count(*) AS runs, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (toxic = 1) AS flagged, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def manifest_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_ids(spark, sf_dir):
    return joins.missing(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def assigned_twice(spark, sf_dir):
    return joins.assigned_twice(_table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), q AS (SELECT page_id, split_part(path, '/', 1) AS first, lower(path) AS path, string_split(lower(path), '/')[-1] AS name FROM p)
SELECT page_id, lpad(page_id::VARCHAR, 6, '0') || '-' || first AS label, first AS "group", string_split(name, '.')[-1] IN ('html', 'php') AND (contains(name, '1') OR string_split(path, '/')[-2] = 'comparisons') AS comparison FROM q""")
def path_classify(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    group = scalars.path_group(path, {})
    return _table(spark, sf_dir, "pages").select("page_id", F.concat_ws("-", scalars.padded_id(F.col("page_id"), 6), group).alias("label"), group.alias("group"), scalars.is_comparison(path, [".html", ".php"], ["1"]).alias("comparison"))


_NUM = "-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


@query(f"""WITH n AS (SELECT page_id, list_transform(regexp_extract_all(url, '({_NUM})', 1), lambda v: CAST(v AS DOUBLE)) AS v FROM pages), s AS (SELECT page_id, len(v) AS k, list_filter(v, lambda e, i: i % 2 = 1) AS xs, list_filter(v, lambda e, i: i % 2 = 0) AS ys FROM n)
SELECT page_id, CASE WHEN k >= 2 AND k % 2 = 0 THEN list_min(xs) END AS x0, CASE WHEN k >= 2 AND k % 2 = 0 THEN list_max(ys) END AS y1 FROM s""")
def numeric_token_bounds(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", scalars.path_bounds(F.col("url")).alias("b")).select("page_id", "b.x0", "b.y1")


@query("SELECT event_id, lower(k) AS name FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)")
def json_keys(spark, sf_dir):
    return validate.nested_keys(_table(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT conv_id, turn, replace(replace(replace(text, 'the', '<the>'), 'and', '&'), '<the>', 'THE') AS text FROM conversations")
def ordered_replace(spark, sf_dir):
    pairs = [("the", "<the>"), ("and", "&"), ("<the>", "THE")]
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.ordered_replace(F.col("text"), pairs).alias("text"))


@query("SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM conversations")
def xml_escaped(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.xml_escape(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT page_id, greatest(320, length(html)) AS w, greatest(200, length(url) * 9) AS h FROM pages), c AS (SELECT *, greatest(1, CAST(round_even(least(w, h) * 0.018, 0) AS INT)) AS c, greatest(3, CAST(round_even(least(w, h) * 0.012, 0) AS INT)) AS m FROM w)
SELECT page_id, c AS clearance, greatest(3, c + 3) AS margin, 2 * (c + greatest(3, c + 3)) + 1 AS field_kernel, 2 * c + 1 AS occluder_kernel, m AS bleed FROM c""")
def seam_geometry(spark, sf_dir):
    w, h = F.greatest(F.lit(320), F.length("html")), F.greatest(F.lit(200), F.length("url") * 9)
    return _table(spark, sf_dir, "pages").select("page_id", scalars.underlap(w, h, F.lit(0.018)).alias("s"), scalars.bleed_margin(w, h).alias("bleed")).select("page_id", "s.*", "bleed")


# ---------------------------------------------------------------- large raster
@query("""WITH p AS (SELECT l_suppkey AS y, l_partkey AS x, sum(l_quantity) AS q, sum(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT y, count(*) AS pixels, round(sum(q), 2) AS quantity, round(median(q), 2) AS median_quantity, round(quantile_cont(q, 0.82), 2) AS p82, max(n) AS most FROM p GROUP BY 1""")
def raster_rollup_bench(spark, sf_dir):
    cells = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return cells.groupBy("y").agg(F.count("*").alias("pixels"), F.round(F.sum("q"), 2).alias("quantity"), F.round(F.median("q"), 2).alias("median_quantity"), F.round(F.percentile("q", F.lit(0.82)), 2).alias("p82"), F.max("n").alias("most"))


# ---------------------------------------------------------------- palettes, order-dependent geometry and whole documents
def _sql_oklab(table: str, keep: str) -> str:
    """Columns kept, and L, a, bb of r, g, b."""
    linear = f"SELECT *, {', '.join(_sql_linear(c) + f' AS l{c}' for c in 'rgb')} FROM {table}"
    root = f"SELECT *, {', '.join(f'cbrt({_sql_dot(row, ["lr", "lg", "lb"])}) AS k{i}' for i, row in enumerate(_TO_LMS))} FROM ({linear})"
    return f"SELECT {keep}, {', '.join(f'{_sql_dot(row, ["k0", "k1", "k2"])} AS {n}' for n, row in zip(('L', 'a', 'bb'), _TO_LAB, strict=True))} FROM ({root})"


def _sql_boxes(last: int) -> str:
    """Tables c0 to c{last} of distinct colours and their boxes; each step halves the widest box of an image."""
    steps = ["c0 AS MATERIALIZED (SELECT image_id, r, g, b, count(*) AS n, 0 AS box FROM rgb GROUP BY ALL)"]
    of = "CASE channel WHEN 1 THEN r WHEN 2 THEN g ELSE b END"
    for k in range(1, last + 1):
        steps.append(f"""wide{k} AS (SELECT image_id, box, [max(r) - min(r), max(g) - min(g), max(b) - min(b)] AS spans FROM c{k - 1} GROUP BY ALL),
pick{k} AS (SELECT DISTINCT ON (image_id) image_id, box, list_position(spans, list_max(spans)) AS channel, list_max(spans) AS span FROM wide{k} ORDER BY image_id, span DESC, box),
level{k} AS (SELECT image_id, {of} AS v, sum(n) AS n FROM c{k - 1} JOIN pick{k} USING (image_id, box) WHERE span > 0 GROUP BY ALL),
upto{k} AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS upto, sum(n) OVER (PARTITION BY image_id) AS total, max(v) OVER (PARTITION BY image_id) AS top FROM level{k}),
mid{k} AS (SELECT image_id, least(min(v), min(top) - 1) AS middle FROM upto{k} WHERE upto * 2 >= total GROUP BY image_id),
c{k} AS MATERIALIZED (SELECT c.image_id, r, g, b, n, CASE WHEN c.box = p.box AND {of} > middle THEN {k} ELSE c.box END AS box FROM c{k - 1} c JOIN pick{k} p ON c.image_id = p.image_id LEFT JOIN mid{k} m ON c.image_id = m.image_id)""")
    return ", ".join(steps)


def _sql_roles(roles: int) -> str:
    """Tables t1 to t{roles} of chosen candidates: the commonest, a chromatic one of some size, then the farthest ones."""
    steps = [
        "cand AS (SELECT image_id, box AS candidate, CAST(round_even(median(r), 0) AS INT) AS r, CAST(round_even(median(g), 0) AS INT) AS g, CAST(round_even(median(b), 0) AS INT) AS b, count(*) AS population FROM rgb JOIN boxed USING (image_id, r, g, b) GROUP BY 1, 2)",
        f"tinted AS ({_sql_oklab('cand', 'image_id, candidate, r, g, b, population')})",
        "q AS MATERIALIZED (SELECT *, population / sum(population) OVER i AS share, sqrt(a * a + bb * bb) AS chroma, 0.35::DOUBLE + 0.65::DOUBLE * sqrt(population / max(population) OVER i) AS w, count(*) OVER i AS k FROM tinted WINDOW i AS (PARTITION BY image_id))",
        "common AS (SELECT DISTINCT ON (image_id) image_id, candidate, 0 AS label FROM q ORDER BY image_id, population DESC, candidate)",
        "vivid AS (SELECT DISTINCT ON (image_id) image_id, candidate, chroma FROM q WHERE share >= 0.004 ORDER BY image_id, chroma DESC, candidate)",
        "t1 AS MATERIALIZED (SELECT * FROM common UNION ALL SELECT v.image_id, v.candidate, 1 FROM vivid v JOIN common c ON v.image_id = c.image_id AND v.candidate <> c.candidate WHERE v.chroma >= 0.04)",
    ]
    for k in range(2, roles + 1):
        steps.append(f"""near{k} AS (SELECT q.image_id, q.candidate, sqrt(min(pow(q.L - z.L, 2) + pow(q.a - z.a, 2) + pow(q.bb - z.bb, 2))) * min(q.w) AS d, count(*) AS had FROM q JOIN t{k - 1} t ON t.image_id = q.image_id JOIN q z ON z.image_id = t.image_id AND z.candidate = t.candidate
GROUP BY 1, 2, q.k HAVING count(*) < least({roles}, q.k) AND NOT bool_or(z.candidate = q.candidate)),
t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} UNION ALL SELECT * FROM (SELECT DISTINCT ON (image_id) image_id, candidate, had FROM near{k} ORDER BY image_id, d DESC, candidate))""")
    return ", ".join(steps)


@query(f"""WITH {_RGB}, {_sql_boxes(11)}, boxed AS (SELECT * FROM c11), {_sql_roles(6)}
SELECT image_id, candidate, r, g, b, round(L, 6) AS L, round(a, 6) + 0.0 AS a, round(bb, 6) + 0.0 AS bb, CAST(label AS INT) AS label FROM t6 JOIN q USING (image_id, candidate)""")
def farthest_point_palette(spark, sf_dir):
    return palette.quantised(_rgb(spark, sf_dir), 6)[1].withColumns({c: _round(c) for c in ("L", "a", "bb")})


@query(f"""WITH RECURSIVE {_GRAY}, h AS (SELECT image_id, CAST(height AS INT) AS rows, greatest(4, CAST(round_even(0.028 * height, 0) AS INT)) AS step, width FROM frame), col AS (SELECT image_id, x, list(v::DOUBLE ORDER BY y) AS s FROM gray GROUP BY 1, 2),
w AS (SELECT image_id, 0 AS x, s AS total, NULL::INT[] AS came FROM col WHERE x = 0 UNION ALL
SELECT image_id, x, list_transform(range(1, rows + 1), lambda y: o[y].best + s[y]), list_transform(range(1, rows + 1), lambda y: o[y].move) FROM (SELECT w.image_id, col.x, col.s, h.rows, list_transform(range(1, h.rows + 1), lambda y: list_max(list_transform(list_filter(range(-h.step, h.step + 1), lambda m: y + m BETWEEN 1 AND h.rows),
lambda m: {{'best': w.total[y + m] - (0.0045::DOUBLE * (m * m) + 0.0040::DOUBLE * abs(m)), 'k': -m, 'move': CAST(m AS INT)}}))) AS o FROM w JOIN col ON col.image_id = w.image_id AND col.x = w.x + 1 JOIN h ON h.image_id = w.image_id)),
fin AS (SELECT w.image_id, w.x, CASE WHEN list_max(s) > 0 THEN list_position(list_transform(s, lambda v: v >= 0.94::DOUBLE * list_max(s)), true) ELSE list_position(s, list_max(s)) END AS y FROM w JOIN h ON h.image_id = w.image_id AND w.x = h.width - 1 JOIN col ON col.image_id = w.image_id AND col.x = w.x),
b AS (SELECT image_id, x, CAST(y AS INT) AS y FROM fin UNION ALL SELECT b.image_id, CAST(b.x - 1 AS INT), b.y + w.came[b.y] FROM b JOIN w ON w.image_id = b.image_id AND w.x = b.x WHERE b.x > 0) SELECT image_id, x, CAST(y - 1 AS INT) AS y FROM b""")
def contour_dp(spark, sf_dir):
    return geometry.contours(_gray(spark, sf_dir), "v")


@query()
def bezier_paths(spark, sf_dir):
    return geometry.path_table(regions.boundary_edges(K.stored(K.components(_mask(_gray(spark, sf_dir))))))


@query()
def source_gradients(spark, sf_dir):
    rows = joins.nearest_centre(_rgb(spark, sf_dir), ["r", "g", "b"], _ROLES)
    return geometry.source_gradients(rows, ["image_id", "label"], raster.frames(rows))


@query()
def point_highlights(spark, sf_dir):
    rows = _gray(spark, sf_dir).select(*PIXEL, *((F.col("v") * 0.6).cast("int").alias(c) for c in "rgb"))
    return document.highlights(rows, _frames(rows))


@query()
def svg_documents(spark, sf_dir):
    return abstraction(_rgb(spark, sf_dir), Options(palette_size=4, max_shapes=6)).select("image_id", "svg", "plan")


@query()
def svg_validation(spark, sf_dir):
    docs = validate.measured(svg_documents(spark, sf_dir).withColumn("plan", F.try_parse_json("plan")))
    return validate.reports(validate.validated(docs, "image_id", validate.structural_rules() | validate.plan_rules()), "image_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
