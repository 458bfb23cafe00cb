"""More registered queries, one for each smaller operator: colour, scalars, text, masks, stencils, aggregates and joins.

They read whole tables like those of the catalogue, share its rasters, and have SQL of their own beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import aggregates, joins, masks, regions, stencils
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL
from pixelloom.plans.catalogue import _BACK_TO_LMS, _BACK_TO_RGB, _CLOSED, _GRAY, _LAB, _RGB, _cast, _dark, _frames, _gray, _lab, _labels, _mask, _rgb, _round, _sql_convolve, _sql_dilated, _sql_dot, _sql_eroded, _table, registrar

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
query = registrar(_QUERIES, _SQL)


# ---------------------------------------------------------------- colour
@query(f"""WITH {_RGB} SELECT image_id, y, x, greatest(0, least(255, r * 2 - 100)) AS clamped, CAST(floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5) AS INT) AS grey, r - b AS warmth,
(r + b) / 2.0::DOUBLE - g AS atmosphere, CAST(floor(r * 0.72::DOUBLE + 71.4::DOUBLE) AS INT) AS star FROM rgb""")
def color_scalars(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    return _rgb(spark, sf_dir).select(*PIXEL, color.clamp(r * 2 - 100, 0, 255).alias("clamped"), color.grey(r, g, b).alias("grey"), color.warmth(r, b).alias("warmth"), color.atmospheric_chroma(r, g, b).alias("atmosphere"), color.star_color(r).alias("star"))


@query(f"""WITH {_LAB} SELECT image_id, y, x, round((a * 0.08::DOUBLE + bb * 0.05::DOUBLE) / greatest(1e-8, sqrt(a*a + bb*bb) * sqrt(0.08::DOUBLE * 0.08 + 0.05::DOUBLE * 0.05)), 6) + 0.0 AS hue,
round(sqrt(pow(L - 0.6::DOUBLE, 2) + pow(a - 0.08::DOUBLE, 2) + pow(bb - 0.05::DOUBLE, 2)), 6) AS distance FROM lab""")
def hue_and_distance(spark, sf_dir):
    own, other = [F.col(c) for c in ("L", "a", "bb")], [F.lit(v) for v in (0.6, 0.08, 0.05)]
    return _lab(spark, sf_dir).select(*PIXEL, _round(color.hue_cosine(own, other)).alias("hue"), F.round(color.oklab_distance(own, other), 6).alias("distance"))


_BALANCED = f"""WITH {_LAB}, seed AS (SELECT image_id, y, x, r, g, b, greatest(0.055::DOUBLE, least(0.94::DOUBLE, L + 0.3::DOUBLE)) AS L, least(sqrt(a*a + bb*bb), 0.18::DOUBLE) AS c, atan2(bb, a) AS h FROM lab),
s AS (SELECT image_id, y, x, r, g, b, i, L, c * pow(0.94::DOUBLE, i) * cos(h) AS a2, c * pow(0.94::DOUBLE, i) * sin(h) AS b2 FROM seed, range(0, 32) t(i)),
c AS (SELECT *, {", ".join(f"pow({_sql_dot(row, ['L', 'a2', 'b2'])}, 3) AS c{i}" for i, row in enumerate(_BACK_TO_LMS))} FROM s),
o AS (SELECT *, {", ".join(f"{_sql_dot(row, ['c0', 'c1', 'c2'])} AS o{i}" for i, row in enumerate(_BACK_TO_RGB))} FROM c),
best AS (SELECT image_id, y, x, r, g, b, min(i) FILTER (least(o0, o1, o2) >= -1e-5 AND greatest(o0, o1, o2) <= 1.00001) AS i FROM o GROUP BY ALL)
SELECT b.image_id, CAST(b.i AS INT) AS tries, count(*) AS pixels, {", ".join(f"CAST(sum(coalesce(CAST(round_even(255 * (CASE WHEN o{k} <= 0.0031308 THEN greatest(o{k}, 0) * 12.92::DOUBLE ELSE pow(least(o{k}, 1), 1 / 2.4::DOUBLE) * 1.055 - 0.055 END), 0) AS INT), b.{n})) AS BIGINT) AS {n}" for k, n in enumerate("rgb"))}
FROM best b LEFT JOIN o ON o.image_id = b.image_id AND o.y = b.y AND o.x = b.x AND o.i = b.i GROUP BY 1, 2"""


@query(f"WITH t AS ({_BALANCED}) SELECT image_id, CAST(sum(pixels) AS BIGINT) AS pixels, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in 'rgb')} FROM t GROUP BY 1")
def balanced_colors(spark, sf_dir):
    out = color.balanced(F.col("r"), F.col("g"), F.col("b"), 0.3)
    return _rgb(spark, sf_dir).select("image_id", out.alias("c")).groupBy("image_id").agg(F.count("*").alias("pixels"), *(F.sum(f"c.{n}").alias(n) for n in "rgb"))


@query(f"""WITH {_RGB}, p AS (SELECT *, CASE x % 4 WHEN 0 THEN 'sky' WHEN 1 THEN 'foreground' WHEN 2 THEN 'star' ELSE 'other' END AS role FROM rgb)
SELECT image_id, role, CAST(sum(CASE role WHEN 'sky' THEN 21 WHEN 'foreground' THEN 112 WHEN 'star' THEN 232 ELSE r END) AS BIGINT) AS r, CAST(sum(CASE role WHEN 'sky' THEN 25 WHEN 'foreground' THEN 72 WHEN 'star' THEN 215 ELSE g END) AS BIGINT) AS g,
CAST(sum(CASE role WHEN 'sky' THEN 24 WHEN 'foreground' THEN 50 WHEN 'star' THEN 207 ELSE b END) AS BIGINT) AS b FROM p GROUP BY 1, 2""")
def night_output_colors(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("sky", "foreground", "star", "other"))), F.col("x") % 4 + 1)
    rows = _rgb(spark, sf_dir).withColumn("role", role)
    out = color.output_color(F.col("r"), F.col("g"), F.col("b"), "curated-night", F.col("role"))
    return rows.select("image_id", "role", out.alias("c")).groupBy("image_id", "role").agg(*(F.sum(f"c.{n}").alias(n) for n in "rgb"))


# ---------------------------------------------------------------- scalars
@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_extendedprice AS d FROM lineitem),
q AS (SELECT *, sqrt(pow(b - 3, 2) + pow(c - a, 2)) AS size FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN size = 0 THEN sqrt(pow(d - 3, 2) + pow(b - a, 2)) ELSE abs((c - a) * d - (b - 3) * b + b * a - c * 3) / size END, 4) AS distance,
round(exp(-pow((a - 25) / 10.0::DOUBLE, 2)), 6) AS prior, least(b, c) / greatest(1e-9, greatest(b, c)) AS symmetry, d / (a * 200) AS compactness, least(a, b + 1) / greatest(a, b + 1) AS aspect FROM q""")
def shape_scalars(spark, sf_dir):
    a, b, c, d = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.line_distance(d, b, F.lit(3), a, b, c), 4).alias("distance"), F.round(scalars.centre_prior(a, F.lit(50.0)), 6).alias("prior"),
        scalars.symmetry(b, c).alias("symmetry"), scalars.compactness(d, a, F.lit(200)).alias("compactness"), scalars.aspect(a, b + 1).alias("aspect"),
    )


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'px' WHEN 1 THEN p_size || '' WHEN 2 THEN p_size || 'em' ELSE 'px' END AS text, p_size FROM part)
SELECT p_partkey, text, CASE WHEN regexp_matches(text, '^[0-9]+(px)?$') THEN CAST(regexp_extract(text, '^([0-9]+)', 1) AS INT) END AS pixels, CAST(greatest(3, CAST(round_even(least(p_size, 30) * 0.2::DOUBLE, 0) AS INT) + (CAST(round_even(least(p_size, 30) * 0.2::DOUBLE, 0) AS INT) + 1) % 2) AS INT) AS kernel,
CAST(p_partkey // 7 AS INT) AS row, CAST(p_partkey % 7 AS INT) AS col FROM t""")
def dimension_parse(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    text = F.element_at(F.array(F.concat("p_size", F.lit("px")), F.col("p_size").cast("string"), F.concat("p_size", F.lit("em")), F.lit("px")), (F.col("p_partkey") % 4 + 1).cast("int"))
    place = scalars.grid_place(F.col("p_partkey"), 7)
    return part.select("p_partkey", text.alias("text"), scalars.dimension(text).alias("pixels"), scalars.gap_kernel(F.col("p_size"), F.lit(30), 0.2).alias("kernel"), place["row"].alias("row"), place["col"].cast("int").alias("col"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 10 AS x0, l_tax * 100 - 4 AS y0, l_quantity + 20 AS x1, l_discount * 100 + 30 AS y1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, x0 < 0 AND y1 > 35 AS left_bottom, y0 < 0 AND x1 > 60 AS top_right, true AS none FROM b""")
def edge_bleeds(spark, sf_dir):
    bounds = F.struct((F.col("l_quantity") - 10).alias("x0"), (F.col("l_tax") * 100 - 4).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 100 + 30).alias("y1"))
    past = lambda *edges: scalars.bleeds(bounds, F.array(*map(F.lit, edges)).cast("array<string>"), F.lit(60), F.lit(35))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", past("left", "bottom").alias("left_bottom"), past("top", "right").alias("top_right"), past().alias("none"))


@query("""SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, lpad(o_orderkey::VARCHAR, greatest(3, length(o_orderkey::VARCHAR))::INT, '0') AS padded, lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || o_orderstatus || '-' || o_orderpriority AS name,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp FROM orders""")
def text_scalars(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.fixed(F.col("o_totalprice")).alias("price"), scalars.padded_id(F.col("o_orderkey")).alias("padded"), scalars.safe_name(F.col("o_custkey") % 1000, F.col("o_orderstatus"), F.col("o_orderpriority")).alias("name"), scalars.iso_seconds(F.col("o_orderdate")).alias("stamp")
    )


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, i, w[i] AS word, array_to_string(w, ' ') AS whole FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
c AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM n), f AS (SELECT *, bool_and(upto + 1 <= 62) OVER (PARTITION BY doc_id ORDER BY i) AS fits FROM c)
SELECT doc_id, CASE WHEN length(any_value(whole)) <= 62 THEN any_value(whole) ELSE coalesce(string_agg(word, ' ' ORDER BY i) FILTER (fits), '') || '…' END AS label FROM f GROUP BY 1""")
def shortened_labels(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", scalars.shortened(F.col("text")).alias("label"))


@query("""SELECT n_nationkey, CAST(i AS INT) AS i, round(n_nationkey * 10 + CASE WHEN i % 2 = 0 THEN 8 ELSE 3 END * cos(i * (2 * pi() / 16) - pi() / 2), 6) + 0.0 AS x, round(n_regionkey * 5 + CASE WHEN i % 2 = 0 THEN 8 ELSE 3 END * sin(i * (2 * pi() / 16) - pi() / 2), 6) + 0.0 AS y FROM nation, range(0, 16) t(i)""")
def star_vertices(spark, sf_dir):
    points = scalars.star_points(F.col("n_nationkey") * 10, F.col("n_regionkey") * 5, F.lit(8), F.lit(3))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(points).alias("i", "p")).select("n_nationkey", "i", _round("p.x").alias("x"), _round("p.y").alias("y"))


# ---------------------------------------------------------------- masks
@query(f"WITH {_RGB} SELECT image_id, y, x FROM rgb WHERE r > 100 AND g < 150 AND b BETWEEN 80 AND 180")
def multi_band_mask(spark, sf_dir):
    return masks.mask_where(_rgb(spark, sf_dir), (F.col("r") > 100) & (F.col("g") < 150) & F.col("b").between(80, 180))


@query(f"WITH {_GRAY} SELECT image_id, y, x FROM mask JOIN frame USING (image_id) WHERE x >= width * 0.1::DOUBLE AND x <= width * 0.9::DOUBLE AND y >= height * 0.25::DOUBLE AND y <= height * 0.8::DOUBLE")
def zoned_mask(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return masks.zone(_mask(gray), _frames(gray), (0.1, 0.9), (0.25, 0.8)).select(*PIXEL)


@query("""WITH k AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY 1) SELECT user_id, have = list_sort(['click', 'view', 'purchase', 'signup', 'error']) AS same, list_has_all(have, ['click', 'error']) AS within FROM k""")
def key_sets(spark, sf_dir):
    keys = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    names = lambda *n: F.array(*map(F.lit, n))
    return keys.select("user_id", masks.same_keys(F.col("have"), names("click", "view", "purchase", "signup", "error")).alias("same"), masks.within_keys(names("click", "error"), F.col("have")).alias("within"))


@query(f"WITH {_GRAY} SELECT image_id, CAST(2 * 20 - 1 - y AS INT) AS y, x FROM mask WHERE 2 * 20 - 1 - y >= 0")
def mirrored_mask(spark, sf_dir):
    return masks.mirrored(_mask(_gray(spark, sf_dir)), F.lit(20)).select(*PIXEL)


# ---------------------------------------------------------------- stencils
_MAJORITY = "SELECT f.image_id, f.y, f.x FROM (SELECT image_id, y + dy AS y, x + dx AS x, count(*) AS n FROM {mask}, range(-1, 2) a(dy), range(-1, 2) b(dx) GROUP BY ALL) f JOIN frame USING (image_id) WHERE x >= 0 AND y >= 0 AND x < width AND y < height AND 2 * n > (least(x + 1, width - 1) - greatest(x - 1, 0) + 1) * (least(y + 1, height - 1) - greatest(y - 1, 0) + 1)"


@query(f"WITH {_GRAY}, {_CLOSED} {_cast(_MAJORITY.format(mask='closed'))}")
def cleaned_mask(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.cleaned(_mask(gray), 3, 3, _frames(gray))


@query(f"WITH {_GRAY}, grown AS ({_sql_dilated('mask', 1)}), shut AS ({_cast(_sql_eroded('grown', 2))}) SELECT * FROM shut")
def asymmetric_close(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.closed(_mask(gray), 3, _frames(gray), 5)


_DENSE = "dense AS (SELECT image_id, y, x, CASE WHEN v > 140 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM gray)"


@query(f"WITH {_GRAY}, {_DENSE}, a AS ({_sql_convolve('dense', 'x', 1.1)}), b AS ({_sql_convolve('a', 'y', 1.1)}) SELECT image_id, y, x FROM b WHERE v >= 0.5")
def smoothed_mask(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.smoothed_boundary(_mask(gray), 1.1, _frames(gray))


@query(f"""WITH {_GRAY}, shrunk AS ({_sql_eroded("dark", 1)}), opened AS ({_cast(_sql_dilated("shrunk", 1))}), new AS (SELECT * FROM opened INTERSECT SELECT * FROM dark),
n AS (SELECT image_id, count(*) AS n FROM dark GROUP BY 1), m AS (SELECT image_id, count(*) AS m FROM new GROUP BY 1), good AS (SELECT image_id FROM n LEFT JOIN m USING (image_id) WHERE coalesce(m, 0) >= greatest(64.0::DOUBLE, n * 0.1::DOUBLE))
SELECT * FROM new WHERE image_id IN (SELECT image_id FROM good) UNION ALL SELECT * FROM dark WHERE image_id NOT IN (SELECT image_id FROM good)""")
def rounded_tips(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return stencils.rounded_tips(_dark(gray), 3, _frames(gray), share=0.1)


@query(f"WITH {_GRAY}, a AS ({_sql_convolve('gray', 'x', 1.7)}) SELECT image_id, y, x, round(v, 6) AS soft FROM a")
def gaussian_along_rows(spark, sf_dir):
    return stencils.convolved(_gray(spark, sf_dir), "v", stencils.weights(1.7), "x", "soft").select(*PIXEL, F.round("soft", 6).alias("soft"))


@query(f"""WITH {_GRAY} SELECT image_id, y, x, v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS across, v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS down FROM gray""")
def pixel_steps(spark, sf_dir):
    return _gray(spark, sf_dir).select(*PIXEL, aggregates.row_step("v").alias("across"), aggregates.column_step("v").alias("down"))


# ---------------------------------------------------------------- aggregates
@query(f"WITH {_RGB} SELECT image_id, y, {', '.join(f'CAST(round_even(quantile_cont({c}, 0.82), 0) AS INT) AS {c}' for c in 'rgb')} FROM rgb GROUP BY 1, 2")
def percentile_colors(spark, sf_dir):
    return aggregates.percentile_color(_rgb(spark, sf_dir), ["image_id", "y"], 0.82)


@query(f"""WITH {_RGB}, m AS (SELECT image_id, y, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM rgb GROUP BY 1, 2)
SELECT image_id, y, round(median(sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2))), 6) AS spread FROM rgb JOIN m USING (image_id, y) GROUP BY 1, 2""")
def color_spread(spark, sf_dir):
    return aggregates.spread(_rgb(spark, sf_dir), ["image_id", "y"], ["r", "g", "b"]).select("image_id", "y", F.round("spread", 6).alias("spread"))


@query(f"""WITH {_LAB}, c AS (SELECT image_id, y AS component, L AS cl, a AS ca, bb AS cb FROM lab WHERE x = 0 AND y % 16 = 0)
SELECT image_id, component, round(avg(CASE WHEN sqrt(pow(L - cl, 2) + pow(a - ca, 2) + pow(bb - cb, 2)) <= 0.06 THEN 1.0 ELSE 0.0 END), 6) AS rarity FROM lab JOIN c USING (image_id) GROUP BY 1, 2""")
def color_rarity(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    centres = lab.where("x = 0 and y % 16 = 0").withColumn("component", F.col("y"))
    return aggregates.rarity(lab, centres, ["L", "a", "bb"], 0.06).select("image_id", "component", F.round("rarity", 6).alias("rarity"))


@query("SELECT n_regionkey, CAST(to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name))) AS VARCHAR) AS counters FROM nation GROUP BY 1")
def counters_by_group(spark, sf_dir):
    return aggregates.counters(_table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "n_nationkey").select("n_regionkey", F.to_json("counters").alias("counters"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def best_by_score(spark, sf_dir):
    return aggregates.best(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id DESC) AS n FROM events) WHERE n = 1")
def first_claims(spark, sf_dir):
    return masks.first_claim(_table(spark, sf_dir, "events"), ["user_id"], "event_type", F.desc("event_id")).select("user_id", "event_id", "event_type")


# ---------------------------------------------------------------- joins
@query(f"""WITH {_LAB}, role(i, rl, ra, rb) AS (VALUES (0, 0.35::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.5, 0.06, 0.04), (2, 0.65, -0.03, 0.02)), d AS (SELECT image_id, y, x, i, pow(L - rl, 2) + pow(a - ra, 2) + pow(bb - rb, 2) AS d FROM lab, role)
SELECT image_id, i AS label, count(*) AS pixels FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY d, i) AS n FROM d) WHERE n = 1 GROUP BY 1, 2""")
def nearest_of_roles(spark, sf_dir):
    lab = joins.nearest_centre(_lab(spark, sf_dir), ["L", "a", "bb"], [(0.35, 0.0, 0.0), (0.5, 0.06, 0.04), (0.65, -0.03, 0.02)])
    return lab.groupBy("image_id", "label").agg(F.count("*").alias("pixels"))


_LATER = "layer AS (SELECT image_id, label AS ord, y, x FROM label UNION ALL SELECT image_id, 1, y, x FROM mask)"


@query(f"WITH {_GRAY}, {_LATER}, o AS (SELECT DISTINCT image_id, ord FROM layer) SELECT o.image_id, o.ord, count(*) AS pixels FROM (SELECT DISTINCT o.image_id, o.ord, l.y, l.x FROM o JOIN layer l ON l.image_id = o.image_id AND l.ord > o.ord) o GROUP BY 1, 2")
def later_layers(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    layers = _labels(gray).select("image_id", F.col("label").alias("ord"), "y", "x").unionByName(_mask(gray).select("image_id", F.lit(1).alias("ord"), "y", "x"))
    return joins.later_union(layers).groupBy("image_id", "ord").agg(F.count("*").alias("pixels"))


@query(f"""WITH {_GRAY}, part AS (SELECT image_id, y, x, CAST(x // 16 AS INT) AS component FROM mask WHERE y < 32), own AS (SELECT image_id, y, x, CAST(y // 16 AS INT) AS owner FROM dark WHERE y >= 32),
a AS (SELECT DISTINCT image_id, component, y + dy AS y, x + dx AS x FROM part, range(-3, 4) s(dy), range(-3, 4) t(dx)), b AS (SELECT DISTINCT image_id, owner, y + dy AS y, x + dx AS x FROM own, range(-2, 3) s(dy), range(-2, 3) t(dx))
SELECT image_id, component, owner, count(*) AS contacts FROM a JOIN b USING (image_id, y, x) JOIN frame USING (image_id) WHERE x >= 0 AND y >= 0 AND x < width AND y < height GROUP BY 1, 2, 3""")
def near_contacts(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    parts = _mask(gray).where("y < 32").withColumn("component", F.floor(F.col("x") / 16).cast("int"))
    owners = _dark(gray).where("y >= 32").withColumn("owner", F.floor(F.col("y") / 16).cast("int"))
    return joins.near_contacts(parts, owners, _frames(gray))


# ---------------------------------------------------------------- components, by a recursive query
_FLOOD = """blank AS (SELECT image_id, y, x FROM gray EXCEPT SELECT image_id, y, x FROM mask),
open AS (SELECT b.* FROM blank b JOIN frame USING (image_id) WHERE x = 0 OR y = 0 OR x = width - 1 OR y = height - 1
UNION SELECT b.image_id, b.y, b.x FROM open o JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx) ON true JOIN blank b ON b.image_id = o.image_id AND b.y = o.y + d.dy AND b.x = o.x + d.dx)"""


@query(f"WITH RECURSIVE {_GRAY}, {_FLOOD} SELECT image_id, y, x FROM mask UNION ALL (SELECT * FROM blank EXCEPT SELECT * FROM open)")
def filled_holes(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return K.filled(_mask(gray), _frames(gray))


@query(f"""WITH {_GRAY} SELECT DISTINCT image_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM mask JOIN frame USING (image_id), range(-2, 3) s(dy), range(-2, 3) t(dx)
WHERE (dx = 0 OR dx < 0 AND x = 0 OR dx > 0 AND x = width - 1) AND (dy = 0 OR dy < 0 AND y = 0 OR dy > 0 AND y = height - 1)""")
def frame_bleed(spark, sf_dir):
    gray = _gray(spark, sf_dir)
    return regions.bled(_mask(gray), _frames(gray), 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
