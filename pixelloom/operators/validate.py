"""Rules over documents and their plans: one boolean column a rule, long form on demand.

The structural rules read the document by XPath; the others compare it with the plan, a struct of the keys that a plan has.
Rules of one archetype pass for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import scalars
from pixelloom.operators import components as K

# What may not stand in a document, and the values that enumerations have.
FORBIDDEN = ("image", "canvas", "foreignObject")
COLOR_MODES, PAPER_STYLES = ("source", "balanced", "curated-night"), ("grain", "rough")
ARCHETYPES = ("general", "night-landscape", "reflective-horizontal-landscape")


def _list(svg: Column, path: str) -> Column:
    return F.xpath(svg, F.lit(path))


def _count(svg: Column, path: str) -> Column:
    return F.xpath_int(svg, F.lit(f"count({path})"))


def measured(docs: DataFrame, svg: str = "svg") -> DataFrame:
    """docs with what the rules look at; a text that is no XML has root null."""
    s = F.col(svg)
    local = lambda n: f"*[local-name()='{n}']"
    fields, noise = f"//{local('g')}[@id='source-derived-fields']/{local('path')}", "//*[@id='surface-noise-layer']"
    return docs.select(
        "*",
        F.xpath_string(s, F.lit("local-name(/*)")).alias("root"),
        scalars.dimension(F.xpath_string(s, F.lit("/*/@width"))).alias("svg_width"),
        scalars.dimension(F.xpath_string(s, F.lit("/*/@height"))).alias("svg_height"),
        F.split(F.trim(F.xpath_string(s, F.lit("/*/@viewBox"))), r"\s+").alias("view_box"),
        F.xpath_string(s, F.lit("/*/@overflow")).alias("overflow"),
        _list(s, f"{fields}/@d").alias("field_paths"),
        _list(s, f"{fields}/@id").alias("field_ids"),
        _count(s, fields).alias("fields"),
        _count(s, f"//{local('path')}").alias("paths"),
        _list(s, f"//{local('path')}/@d").alias("path_data"),
        _count(s, f"//{local('circle')}").alias("points"),
        _count(s, f"//{local('linearGradient')}").alias("gradients"),
        _list(s, f"//{local('linearGradient')}/@id").alias("gradient_ids"),
        _count(s, f"//{local('linearGradient')}[count({local('stop')})=3]").alias("full_gradients"),
        _count(s, f"//{local('feTurbulence')}").alias("turbulence"),
        _count(s, noise).alias("noise_layers"),
        _count(s, f"{noise}/*[not(@id)]").alias("particles"),
        F.size(F.array_distinct(_list(s, f"{noise}/*[not(@id)]/@fill"))).alias("particle_scales"),
        _count(s, "//*[@id='surface-grain'][@filter]").alias("overlays"),
        F.xpath_string(s, F.lit(f"{noise}/*[last()]/@id")).alias("noise_last_id"),
        F.xpath_string(s, F.lit("/*/*[last()]/@id")).alias("last_id"),
        F.filter(F.array(*(F.when(_count(s, f"//{local(n)}") > 0, n) for n in FORBIDDEN)), lambda n: n.isNotNull()).alias("forbidden"),
    )


def structural_rules() -> dict[str, Column]:
    c = F.col
    box = lambda i: F.try_to_number(F.get("view_box", F.lit(i)), F.lit("999999D99"))
    return {
        "root_is_svg": c("root") == "svg",
        "positive_dimensions": (c("svg_width") > 0) & (c("svg_height") > 0),
        "viewbox_matches_dimensions": (F.size("view_box") == 4) & (F.get("view_box", F.lit(0)) == "0") & (F.get("view_box", F.lit(1)) == "0") & (F.rint(box(2).cast("double")) == c("svg_width")) & (F.rint(box(3).cast("double")) == c("svg_height")),
        "root_clips_frame_bleed": c("overflow") == "hidden",
        "has_source_derived_paths": c("fields").between(2, 32),
        "point_highlights_are_restrained": c("points") <= 64,
        "contains_no_embedded_or_canvas_content": F.size("forbidden") == 0,
        "all_paths_have_geometry": (F.size("path_data") == c("paths")) & F.forall("path_data", lambda d: F.trim(d) != ""),
        "structural_paths_use_cubic_curves": (F.size("field_paths") == c("fields")) & F.forall("field_paths", lambda d: d.contains("C ")),
        "surface_noise_filter_is_vector_native": c("turbulence") <= 3,
        "surface_noise_layer_is_unique": c("noise_layers") <= 1,
        "surface_noise_layer_is_topmost": (c("noise_layers") == 0) | (c("last_id") == "surface-noise-layer"),
        "source_gradients_are_restrained": c("gradients") <= c("fields"),
        "source_gradients_have_three_stops": c("full_gradients") == c("gradients"),
        "source_gradient_ids_are_unique": F.size(F.array_distinct("gradient_ids")) == F.size("gradient_ids"),
    }


def _number(key: str) -> Column:
    return F.try_variant_get(F.col("plan"), f"$.{key}", "double")


def _text(key: str) -> Column:
    return F.try_variant_get(F.col("plan"), f"$.{key}", "string")


def _keys(key: str) -> Column:
    return F.map_keys(F.try_variant_get(F.col("plan"), f"$.{key}", "map<string,variant>"))


def _array(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col("plan"), f"$.{key}", f"array<{kind}>")


def _share(key: str) -> Column:
    return _number(key).between(0, 1)


def _at_most_one(prefix: str, low: float, high: float) -> Column:
    """At most one feature, with as many area shares in bounds as its count says."""
    shares = _array(f"{prefix}_area_fractions", "double")
    return (_number(f"{prefix}_count") <= 1) & (F.size(shares) == _number(f"{prefix}_count")) & F.forall(shares, lambda v: v.between(low, high))


def _counters(key: str, ids: Column, least: int = 0) -> Column:
    """A map with a count of at least 0 for each field, and at least so many in all."""
    m = F.try_variant_get(F.col("plan"), f"$.{key}", "map<string,bigint>")
    return (F.array_sort(F.map_keys(m)) == ids) & F.forall(F.map_values(m), lambda v: v >= 0) & (F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v) >= least)


def _some_counts(*keys: str) -> Column:
    """Maps that are there and hold no negative count."""
    out = F.lit(True)
    for key in keys:
        out = out & F.forall(F.map_values(F.try_variant_get(F.col("plan"), f"$.{key}", "map<string,bigint>")), lambda v: v >= 0)
    return out


#: Most curve segments that a loop of a night field may have.
NIGHT_SEGMENTS = {"luminous-sky-field": 48, "foreground-silhouette": 132, "foreground-light": 36}


def _few_segments() -> Column:
    most = F.create_map(*(F.lit(v) for kv in NIGHT_SEGMENTS.items() for v in kv))
    times = lambda text, mark: F.size(F.split(text, mark)) - 1
    return F.forall(F.arrays_zip("field_ids", "field_paths"), lambda f: times(f["field_paths"], "C ") <= F.coalesce(F.element_at(most, f["field_ids"]), F.lit(0)) * times(f["field_paths"], "M "))


def plan_rules() -> dict[str, Column]:
    """Rules that compare a document with its plan, a VARIANT column."""
    general, night, reflective = (_text("archetype") == a for a in ARCHETYPES)
    on = lambda gate, rule: ~F.coalesce(gate, F.lit(False)) | rule
    ids = F.array_sort("field_ids")
    paper = F.coalesce(_number("paper"), F.lit(0.0))
    has = lambda key: F.try_variant_get(F.col("plan"), f"$.{key}", "variant").isNotNull()
    return {
        "analysis_dimensions_match": (_number("width") == F.col("svg_width")) & (_number("height") == F.col("svg_height")),
        "analysis_omits_private_quadrant_confidence": ~F.lower(F.to_json("plan")).rlike(r'"[^"]*(?:confidence|quadrant)[^"]*":'),
        "analysis_declares_svg_renderer": F.lower(_text("renderer")).contains("svg"),
        "analysis_records_clipped_frame_bleed": F.lower(_text("frame_edge_policy")).contains("bleed"),
        "analysis_shape_count_matches": _number("shape_count") == F.col("fields"),
        "analysis_point_count_matches": _number("point_count") == F.col("points"),
        "analysis_color_mode_is_valid": _text("color_mode").isin(*COLOR_MODES),
        "analysis_archetype_is_valid": _text("archetype").isin(*ARCHETYPES),
        "analysis_records_curve_smoothing": _share("curve_smoothing"),
        "analysis_records_gradient_strength": _share("gradient_strength"),
        "analysis_records_negative_gap_floor": _number("min_negative_gap").between(0, 0.08),
        "analysis_gradient_count_matches": _number("gradient_count") == F.col("gradients"),
        "analysis_paper_style_is_valid": _text("paper_style").isin(*PAPER_STYLES),
        "analysis_paper_density_is_valid": _number("paper_density").between(0.25, 4),
        "analysis_grain_overlay_is_valid": _share("grain_overlay"),
        "analysis_vector_particle_count_matches": F.coalesce(_number("particle_count"), F.lit(0.0)) == F.col("particles"),
        "analysis_noise_layer_matches": (F.coalesce(_number("paper"), F.lit(0.0)) > 0) == (F.col("noise_layers") > 0),
        "analysis_records_compact_salient_islands": _at_most_one("compact_salient_island", 0.0, 0.05),
        "analysis_records_focal_support_fields": _at_most_one("focal_support_field", 0.0, 0.35),
        "analysis_records_perspective_accent_lines": _at_most_one("perspective_accent_line", 0.0, 0.05),
        "general_fields_report_seam_underlap": on(general, F.array_sort(_keys("seam_underlap_added_pixels")) == ids),
        "general_fields_bleed_past_touched_frame_edges": on(general, F.array_sort(_keys("frame_edges")) == ids),
        "general_fields_report_micro_hole_cleanup": on(general, _number("micro_hole_limit") >= 0),
        "traditional_grain_overlay_matches": ((F.coalesce(_number("grain_overlay"), F.lit(0.0)) > 0) & (_text("paper_style") == "rough")) == (F.col("overlays") == 1),
        "traditional_grain_overlay_is_topmost": (F.col("overlays") == 0) | (F.col("noise_last_id") == "surface-grain"),
        "analysis_paper_texture_model_is_valid": _text("paper_texture_model") == F.when(paper == 0, "none").when(_text("paper_style") == "grain", "grain").when(F.col("overlays") > 0, "vector particles with grain").otherwise("vector particles"),
        "rough_paper_uses_three_vector_scales": on((_text("paper_style") == "rough") & (paper > 0), F.col("particle_scales") == 3),
        "general_fields_use_light_contour_low_pass": on(general, (_number("contour_low_passes") == 4) & (_number("compact_contour_low_passes") == 2)),
        "general_fields_report_discarded_region_merge": on(general, _counters("merged_components", ids) & _counters("merged_pixels", ids)),
        "general_fields_report_negative_space_consolidation": on(
            general,
            (_number("negative_space_kernel") % 2 == 1) & (_number("negative_space_hole_limit") >= 0) & (_number("negative_space_closed_pixels") >= 0) & (_number("negative_space_holes_filled") >= 0)
            & _counters("negative_space_components", ids) & _counters("negative_space_pixels", ids),
        ),
        "general_fields_report_unrepresented_hole_merge": on(general, _counters("unrepresented_holes", ids) & _counters("unrepresented_hole_pixels", ids)),
        "general_fields_report_chromatic_false_background_merge": on(general, (has("false_background_holes") == has("false_background_pixels")) & on(has("false_background_holes"), _counters("false_background_holes", ids, 1) & _counters("false_background_pixels", ids, 1))),
        "night_landscape_curve_segments_are_minimal": on(night, _few_segments()),
        "night_landscape_reports_gap_closure": on(night, (_number("gap_closure_kernel") % 2 == 1) & (_number("gap_pixels_closed") >= 0)),
        "night_landscape_reports_seam_overlap": on(night, _some_counts("seam_underlap_added_pixels")),
        "night_landscape_regularizes_internal_contours": on(night, _text("internal_contour_policy").contains("rounded") & _some_counts("internal_rounding_kernels", "internal_edge_snap_pixels")),
        "night_landscape_has_reduced_shape_budget": on(night, F.col("fields") <= 3),
        "night_landscape_declares_spline_fitter": on(night, F.lower(_text("curve_model")).contains("spline")),
        "reflective_fields_report_measured_pairing": on(reflective, (F.col("points") == 0) & (_number("reflection_score") >= 0.72)),
        "source_mode_preserves_sampled_palette": on(_text("color_mode") == "source", F.array_sort(_array("palette", "string")) == F.array_sort(_array("sampled_palette", "string"))),
        "source_palette_reports_diverse_roles": (F.size(_array("palette_seed_colors", "string")) >= 2) & (F.abs(F.aggregate(_array("palette_population_fractions", "double"), F.lit(0.0), lambda a, v: a + v) - 1) < 1e-3),
    }


def validated(docs: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, check, passed): a rule that cannot be judged fails."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in rules.items()))).alias("c")
    return docs.select(key, pairs).select(key, "c.check", "c.passed")


def reports(checks: DataFrame, key: str) -> DataFrame:
    """(key, result, failed_checks): PASS or FAIL, and the failed rules joined by ;"""
    failed = F.array_sort(F.filter(F.collect_list(F.struct("passed", "check")), lambda c: ~c["passed"]))
    return checks.groupBy(key).agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("result"), F.array_join(F.transform(failed, lambda c: c["check"]), ";").alias("failed_checks"))


def path_pairs(docs: DataFrame, entries: str, svg: str = "svg", plan: str = "plan", key: str = "image_id") -> DataFrame:
    """(key, path_id, in_svg, in_plan, bounds, edges, bleeds): the paths of documents beside the entries of their plans.

    docs (key, svg, plan: a VARIANT, width, height). The paths are the elements named path with an id; `entries` names the plan's
    map of path ids to the frame edges that a field touches. Both are exploded and joined in full, so that what stands on one
    side only is kept. bleeds: whether the path reaches past all of its edges; null where either side lacks it.
    A path id that occurs twice in a document stands twice; a text that is no XML has no paths, a plan without the map no entries.
    """
    local = "//*[local-name()='path'][@id]"
    s = F.col(svg)
    rows = docs.select(key, "width", "height", F.xpath(s, F.lit(f"{local}/@id")).alias("ids"), F.xpath(s, F.lit(f"{local}/@d")).alias("ds"), F.try_variant_get(F.col(plan), f"$.{entries}", "map<string,array<string>>").alias("entries"))
    drawn = rows.select(key, F.explode(F.arrays_zip("ids", "ds")).alias("e")).select(key, F.col("e.ids").alias("path_id"), scalars.path_bounds(F.col("e.ds")).alias("bounds"), F.lit(True).alias("_s"))
    planned = rows.select(key, F.explode("entries").alias("path_id", "edges")).withColumn("_p", F.lit(True))
    both = drawn.join(planned, [key, "path_id"], "full").join(rows.select(key, "width", "height"), key)
    has = [F.coalesce(F.col(c), F.lit(False)).alias(n) for c, n in (("_s", "in_svg"), ("_p", "in_plan"))]
    bleeds = F.when(F.col("_s") & F.col("_p"), scalars.bleeds(F.col("bounds"), F.col("edges"), F.col("width"), F.col("height")))
    return both.select(key, "path_id", *has, "bounds", "edges", bleeds.alias("bleeds"))


def nested_keys(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name): lower-cased keys of a JSON text on all levels. Each round opens what the last one found, until nothing is
    left to open, so that no depth is lost; a text that is no JSON has no keys."""
    level = K.stored(rows.select(F.col(key).alias("_key"), F.try_parse_json(F.col(document)).alias("v")).where("v is not null"))
    out = None
    while True:
        objects = level.select("_key", F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e"))
        items = level.select("_key", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
        names = objects.select("_key", F.lower("e.key").alias("name"))
        out = names if out is None else out.unionByName(names)
        below = objects.select("_key", F.col("e.value").alias("v")).unionByName(items)
        inner = F.schema_of_variant("v")
        level = K.stored(below.where(inner.startswith("OBJECT") | inner.startswith("ARRAY")))
        if not level.limit(1).count():
            return out.distinct().withColumnRenamed("_key", key)
