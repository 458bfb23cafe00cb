"""Registered queries that hold results against each other: drawn pixels against fields, documents against plans, listings
against listings, and merges in reading order. They read whole tables and have SQL of their own where SQL can say it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.operators import coverage, geometry, joins, regions, validate
from pixelloom.operators import components as K
from pixelloom.operators.masks import PIXEL
from pixelloom.plans.catalogue import _EV, _GRAY, _LEVELS, _RGB, _ROLES, _frames, _gray, _labels, _mask, _rgb, _round, _series, _sql_reach, _table, registrar
from pixelloom.sources import raster, runs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
query = registrar(_QUERIES, _SQL)


# ---------------------------------------------------------------- coverage
@query(f"""WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')}, s AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, component, y ORDER BY x) AS island FROM c)
SELECT image_id, component, y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM s GROUP BY image_id, component, y, island""")
def outline_scan_fill(spark, sf_dir):
    """Outlines of components filled again: their runs of pixels."""
    edges = regions.boundary_edges(K.stored(K.components(_mask(_gray(spark, sf_dir)))))
    return coverage.scan_filled(edges.select("image_id", "component", *(F.col(o).cast("double").alias(n) for o, n in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1")))), "component")


_POINT = "CASE k WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
#: Corners of a star in the order of its strokes, as shares of a radius.
_STAR_X, _STAR_Y = (0.0, 0.5878, -0.9511, 0.9511, -0.5878), (-1.0, 0.809, -0.309, -0.309, 0.809)


@query(f"""WITH p AS (SELECT s_suppkey AS image_id, CAST(s_nationkey AS BIGINT) AS part, 6.0::DOUBLE + s_suppkey % 17 AS radius, 30.25::DOUBLE + s_nationkey % 5 AS cx, 31.0::DOUBLE - s_suppkey % 7 * 0.25 AS cy FROM supplier),
c AS (SELECT image_id, part, cx, cy, radius, k, {_POINT.format(*_STAR_X)}::DOUBLE AS sx, {_POINT.format(*_STAR_Y)}::DOUBLE AS sy FROM p, range(0, 5) t(k)), v AS (SELECT image_id, part, k, cx + radius * sx AS x, cy + radius * sy AS y FROM c),
e AS (SELECT a.image_id, a.part, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON a.image_id = b.image_id AND b.k = (a.k + 1) % 5),
q AS (SELECT image_id, part, py, px, count(*) AS n FROM e, range(0, 64) r(py), range(0, 64) q(px) WHERE (y0 <= py + 0.5) <> (y1 <= py + 0.5) AND x0 + (py + 0.5 - y0) * (x1 - x0) / (y1 - y0) <= px + 0.5 GROUP BY ALL)
SELECT image_id, part, count(*) AS covered, sum(px)::BIGINT AS sum_x, sum(py)::BIGINT AS sum_y FROM q WHERE n % 2 = 1 GROUP BY 1, 2""")
def star_scan_fill(spark, sf_dir):
    """Stars of crossing strokes, whose middle is not filled."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_nationkey").cast("long").alias("part"), (F.col("s_suppkey") % 17 + 6.0).alias("radius"), (F.col("s_nationkey") % 5 + 30.25).alias("cx"), (F.lit(31.0) - F.col("s_suppkey") % 7 * 0.25).alias("cy"))
    corner = lambda i: (F.col("cx") + F.col("radius") * _STAR_X[i % 5], F.col("cy") + F.col("radius") * _STAR_Y[i % 5])
    strokes = F.array(*(F.struct(*(c.alias(n) for c, n in zip((*corner(i), *corner(i + 1)), ("x0", "y0", "x1", "y1"), strict=True))) for i in range(5)))
    lines = rows.select("image_id", "part", F.explode(strokes).alias("s")).select("image_id", "part", "s.*")
    frames = rows.select("image_id", F.lit(64).alias("width"), F.lit(64).alias("height"))
    drawn = coverage.covered_pixels(coverage.scan_filled(lines, "part"), "part", frames)
    return drawn.groupBy("image_id", "part").agg(F.count("*").alias("covered"), F.sum("x").cast("long").alias("sum_x"), F.sum("y").cast("long").alias("sum_y"))


@query(f"""WITH RECURSIVE {_GRAY}, {_sql_reach('c', 'mask')} SELECT image_id, component, count(*) AS pixels, count(*) AS covered, 0::BIGINT AS lost, 0::BIGINT AS leaked FROM c GROUP BY 1, 2""")
def outline_coverage(spark, sf_dir):
    """Straight outlines lose and leak nothing."""
    parts = K.stored(K.components(_mask(_gray(spark, sf_dir))))
    edges = regions.boundary_edges(parts).select("image_id", "component", *(F.col(o).cast("double").alias(n) for o, n in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1"))))
    drawn = coverage.covered_pixels(coverage.scan_filled(edges, "component"), "component", _frames(_gray(spark, sf_dir)))
    return coverage.audit(parts, drawn, "component")


@query()
def curve_coverage(spark, sf_dir):
    """Pixels that the fitted curves of components lose and gain; tests compare with filling by winding of dense samples."""
    gray = _gray(spark, sf_dir)
    parts = K.stored(K.components(_mask(gray)))
    cubics = coverage.crossing(geometry.segment_table(regions.boundary_edges(parts)))
    lines = coverage.flattened(cubics, "component")
    return coverage.audit(parts, coverage.covered_pixels(coverage.scan_filled(lines, "component"), "component", K.stored(_frames(gray))), "component")


_BANDS = {"p": [1, 8, 28, 56, -186, 56, 28, 8, 1], "b": [1, 8, 12, -8, -26, -8, 12, 8, 1]}  # 256ths: broad mean less the point, and less the narrow mean


def _sql_gated(table: str) -> str:
    sums = ", ".join(f"sum(o.{c} * (CASE d {' '.join(f'WHEN {i - 4} THEN {w}' for i, w in enumerate(ws))} END)::DOUBLE / 256.0::DOUBLE) AS {k}_{c}" for k, ws in _BANDS.items() for c in "xy")
    gate = "CASE WHEN n >= 12 THEN greatest(0, least(1, (sqrt(b_x * b_x + b_y * b_y) - 0.16) / 0.42)) * greatest(0, least(1, (4.893 - sqrt(p_x * p_x + p_y * p_y)) / 0.85)) * 0.8584 ELSE 0 END"
    near = f"SELECT e.user_id, e.i, e.n, any_value(e.x) AS x, any_value(e.y) AS y, {sums} FROM {table} e, range(-4, 5) t(d) JOIN {table} o ON o.user_id = e.user_id AND o.i = ((e.i + d) % e.n + e.n) % e.n GROUP BY 1, 2, 3"
    return f"SELECT user_id, i, n, x + p_x * g AS x, y + p_y * g AS y FROM (SELECT *, {gate} AS g FROM ({near}))"


@query(f"WITH {_EV}, a AS ({_sql_gated('ev')}), b AS ({_sql_gated('a')}) SELECT user_id, i, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM b")
def micro_contour_gate(spark, sf_dir):
    """Events of a user as a closed outline, without short and shallow fluctuations."""
    rows = geometry.micro_gated(_series(spark, sf_dir).withColumnRenamed("i", "seq"), ["user_id"])
    return rows.select("user_id", F.col("seq").alias("i"), _round("x", 3).alias("x"), _round("y", 3).alias("y"))


def _sql_stop(end: str, c: str) -> str:
    base = f"base_{c}"
    return f"CAST(round_even(greatest(0, least(255, round_even({base}, 0) + greatest(-48, least(48, coalesce({end}_{c}, {base}) - {base})) * 0.30::DOUBLE)), 0) AS INT)"


_ENDS = {"low": "t <= p18", "mid": "t >= p46 AND t <= p54", "high": "t >= p82"}


@query(f"""WITH {_RGB}, d AS (SELECT *, [{", ".join(f"(r-{a})*(r-{a})+(g-{b})*(g-{b})+(b-{c})*(b-{c})" for a, b, c in _ROLES)}] AS d FROM rgb), l AS (SELECT *, CAST(list_position(d, list_min(d)) - 1 AS INT) AS label FROM d), f AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM rgb GROUP BY 1),
u AS (SELECT l.*, x / greatest(1, w - 1)::DOUBLE AS u, y / greatest(1, h - 1)::DOUBLE AS v FROM l JOIN f USING (image_id)), q AS (SELECT image_id, label, r, g, b, i, axis, CASE i WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN (u + v) / 2.0::DOUBLE ELSE (u + 1.0::DOUBLE - v) / 2.0::DOUBLE END AS t FROM u, (VALUES (0, 'horizontal'), (1, 'vertical'), (2, 'diagonal-down'), (3, 'diagonal-up')) a(i, axis)),
p AS (SELECT image_id, label, i, quantile_cont(t, 0.18) AS p18, quantile_cont(t, 0.46) AS p46, quantile_cont(t, 0.54) AS p54, quantile_cont(t, 0.82) AS p82 FROM q GROUP BY ALL HAVING count(*) >= 64),
e AS (SELECT image_id, label, i, axis, {", ".join(f"median({c}) FILTER ({when}) AS {name}_{c}" for name, when in _ENDS.items() for c in "rgb")}, {", ".join(f"median({c}) AS base_{c}" for c in "rgb")}, count(*) FILTER (t <= p18) AS n_low, count(*) FILTER (t >= p82) AS n_high FROM q JOIN p USING (image_id, label, i) GROUP BY image_id, label, i, axis),
s AS (SELECT *, sqrt(pow((high_r - low_r) * 0.30::DOUBLE, 2) + pow((high_g - low_g) * 0.59::DOUBLE, 2) + pow((high_b - low_b) * 0.11::DOUBLE, 2)) AS score FROM e WHERE n_low >= 16 AND n_high >= 16), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, i) AS k FROM s)
SELECT image_id, label, axis, round(score, 6) AS score, {", ".join(f"{_sql_stop(name, c)} AS {name}_{c}" for name in _ENDS for c in "rgb")} FROM k WHERE k = 1""")
def gradient_stops(spark, sf_dir):
    """The axis and the three stops of each label's gradient, flat."""
    rows = joins.nearest_centre(_rgb(spark, sf_dir), ["r", "g", "b"], _ROLES)
    out = geometry.source_gradients(rows, ["image_id", "label"], raster.frames(rows))
    return out.select("image_id", "label", "axis", F.round("score", 6).alias("score"), *(F.col("stops")[i][c].alias(f"{name}_{c}") for i, name in enumerate(_ENDS) for c in "rgb"))


# ---------------------------------------------------------------- documents and plans, listings
@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'l' || l_linenumber AS path_id, max(l_quantity)::DOUBLE AS q, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), s AS (SELECT * FROM l WHERE l_linenumber % 4 <> 0), p AS (SELECT * FROM l WHERE part % 7 <> 0)
SELECT coalesce(s.l_orderkey, p.l_orderkey) AS order_id, coalesce(s.path_id, p.path_id) AS path_id, s.l_orderkey IS NOT NULL AS in_svg, p.l_orderkey IS NOT NULL AS in_plan, least(20.0 - s.q, s.q) AS x0, greatest(20.0 - s.q, s.q) AS x1,
CASE WHEN s.l_orderkey IS NOT NULL AND p.l_orderkey IS NOT NULL THEN least(20.0 - s.q, s.q) < 0 AND greatest(20.0 - s.q, s.q) > 40 END AS bleeds FROM s FULL JOIN p ON s.l_orderkey = p.l_orderkey AND s.path_id = p.path_id""")
def plan_svg_pairs(spark, sf_dir):
    """A document and a plan an order, both lacking some of its lines; their paths and entries joined in full."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("q"), F.min("l_partkey").alias("part"))
    lines = lines.withColumn("id", F.concat(F.lit("l"), F.col("l_linenumber").cast("string")))
    d = F.format_string("M %s 1 C %s 2 %s 3 %s 4 Z", *((F.lit(20.0) - F.col("q")).cast("string") if i % 2 == 0 else F.col("q").cast("string") for i in range(4)))
    path = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit('<path id="'), F.col("id"), F.lit('" d="'), d, F.lit('"/>')))
    entry = F.when(F.col("part") % 7 != 0, F.struct("id", F.array(F.lit("left"), F.lit("right"))))
    docs = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list(path).alias("paths"), F.map_from_entries(F.collect_list(entry)).alias("frame_edges"))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join("paths", ""), F.lit("</svg>"))
    docs = docs.select("order_id", svg.alias("svg"), F.parse_json(F.to_json(F.struct("frame_edges"))).alias("plan"), F.lit(40).alias("width"), F.lit(8).alias("height"))
    return validate.path_pairs(docs, "frame_edges", key="order_id").select("order_id", "path_id", "in_svg", "in_plan", "bounds.x0", "bounds.x1", "bleeds")


@query("""WITH a AS (SELECT page_id // 2 AS id, url AS path FROM pages), b AS (SELECT doc_id // 3 AS id, source || '/' || doc_id AS path FROM documents WHERE text IS NOT NULL),
x AS (SELECT id, (arg_min(path, struct_pack(n := length(path), p := path))) AS source, count(*) AS n FROM a GROUP BY 1), y AS (SELECT id, arg_min(path, struct_pack(n := length(path), p := path)) AS preview, count(*) AS n FROM b GROUP BY 1)
SELECT id, source, preview, coalesce(x.n, 0) AS source_candidates, coalesce(y.n, 0) AS preview_candidates, CASE WHEN x.n IS NULL THEN 'preview-only' WHEN y.n IS NULL THEN 'source-only' WHEN x.n > 1 OR y.n > 1 THEN 'ambiguous' ELSE 'paired' END AS status FROM x FULL JOIN y USING (id)""")
def paired_listings(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.expr("page_id div 2").alias("id"), F.col("url").alias("path"))
    docs = _table(spark, sf_dir, "documents").where("text is not null").select(F.expr("doc_id div 3").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return joins.paired(pages, docs, "id")


@query("""WITH h AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey <> 3)
SELECT id, coalesce(n, 0) AS times, CASE WHEN n IS NULL THEN 'missing' WHEN w.i IS NULL THEN 'unknown' ELSE 'repeated' END AS problem FROM h FULL JOIN (SELECT id, 1 AS i FROM w) w USING (id) WHERE n IS NULL OR w.i IS NULL OR n > 1""")
def assignment_problems(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("id"))
    return joins.same_ids(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), wanted, "id")


@query("""WITH a AS (SELECT o_orderpriority AS run, o_orderkey AS image_id, 1 AS attempt, 'done' AS status, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS validation, o_custkey % 30 AS shapes FROM orders
UNION ALL SELECT o_orderpriority, o_orderkey, 2, CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'done' END, 'PASS', o_custkey % 7 FROM orders WHERE o_totalprice > 200000), c AS (SELECT *, row_number() OVER (PARTITION BY run, image_id ORDER BY attempt DESC, status DESC, shapes DESC, validation DESC) AS k FROM a)
SELECT run, count(*) AS images, count(*) FILTER (validation = 'PASS') AS passed, count(*) FILTER (status <> 'done') AS failed, sum(shapes)::BIGINT AS shapes FROM c WHERE k = 1 GROUP BY 1""")
def batch_run_summary(spark, sf_dir):
    """Two attempts of a run for each priority, the second first and one of them twice; what counts is the later one."""
    orders = _table(spark, sf_dir, "orders")
    status = F.when(F.col("o_custkey") % 5 == 0, "failed").otherwise("done")
    first = orders.select("o_orderpriority", F.col("o_orderkey").alias("image_id"), F.lit("done").alias("status"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("validation"), (F.col("o_custkey") % 30).alias("shape_count"))
    second = orders.where("o_totalprice > 200000").select("o_orderpriority", F.col("o_orderkey").alias("image_id"), status.alias("status"), F.lit("PASS").alias("validation"), (F.col("o_custkey") % 7).alias("shape_count"))
    folder = f"{K.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for (run,) in orders.select("o_orderpriority").distinct().collect():  # the runs' names, five of them
        for attempt, rows in ((2, second), (1, first), (2, second)):
            runs.append(rows.where(F.col("o_orderpriority") == run), folder, run, attempt)
    return runs.summary(runs.log(spark, folder)).drop("seconds")


# ---------------------------------------------------------------- merges
def _merge_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    gray = _gray(spark, sf_dir)
    parts = K.stored(K.components(_labels(gray).where("label <> 1"), "label"))
    sized = K.stored(parts.withColumn("area", F.count("*").over(Window.partitionBy("image_id", "component"))))
    owner = sized.where("area >= 12").select(*PIXEL, "label", F.col("component").alias("owner"))
    lost = sized.where("area < 12").select(*PIXEL, "label", "component")
    ink = F.element_at(F.array(*(F.lit(v[0]) for v in _LEVELS)), F.col("label") + 1)
    inks = lambda df, key: df.select("image_id", key, "label").distinct().select("*", *(ink.alias(c) for c in "rgb"))
    return lost, owner, K.stored(_frames(gray)), inks(lost, "component").drop("label"), inks(owner, "owner")


@query()
def ordered_merges(spark, sf_dir):
    """Small components merged in reading order; tests flood the pixels one by one."""
    lost, owner, frames, lost_ink, owner_ink = _merge_inputs(spark, sf_dir)
    return regions.merged_in_order(lost, owner, frames, lost_ink, owner_ink)


@query()
def ordered_merge_counts(spark, sf_dir):
    lost, owner, frames, lost_ink, owner_ink = _merge_inputs(spark, sf_dir)
    return regions.merge_counts(regions.merged_in_order(lost, owner, frames, lost_ink, owner_ink), lost, owner)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
