"""Every plan rule passes on a good document and plan, and fails on a mutation of its own."""

import copy
import json

from pyspark.sql import functions as F

from pixelloom.operators import validate

PATH = "M -1 0 C 1 1 2 2 11 3 Z"
RECTS = '<rect fill="#111"/><rect fill="#222"/><rect fill="#333"/>'
SVG = (
    '<svg xmlns="http://www.w3.org/2000/svg" width="10" height="8" viewBox="0 0 10 8" overflow="hidden"><defs><linearGradient id="a"><stop/><stop/><stop/></linearGradient></defs>'
    '<g id="source-derived-fields">{fields}</g><g id="surface-noise-layer">{rects}<rect id="surface-grain" filter="url(#f)"/></g></svg>'
)
COMMON = {
    "width": 10, "height": 8, "renderer": "native SVG paths", "frame_edge_policy": "fields bleed", "shape_count": 2, "point_count": 0, "color_mode": "source", "curve_smoothing": 0.8, "gradient_strength": 0.3, "min_negative_gap": 0.02,
    "gradient_count": 1, "paper_style": "rough", "paper_density": 1.0, "grain_overlay": 0.3, "particle_count": 3, "paper": 0.4, "paper_texture_model": "vector particles with grain", "palette": ["#1", "#2"], "sampled_palette": ["#2", "#1"],
    "palette_seed_colors": ["#1", "#2"], "palette_population_fractions": [0.4, 0.6], "compact_salient_island_count": 1, "compact_salient_island_area_fractions": [0.01], "focal_support_field_count": 0, "focal_support_field_area_fractions": [],
    "perspective_accent_line_count": 0, "perspective_accent_line_area_fractions": [],
}
MAPS = ("seam_underlap_added_pixels", "merged_components", "merged_pixels", "negative_space_components", "negative_space_pixels", "unrepresented_holes", "unrepresented_hole_pixels", "false_background_holes", "false_background_pixels")
GENERAL = COMMON | {k: {"p": 1, "q": 0} for k in MAPS} | {
    "archetype": "general", "frame_edges": {"p": ["left"], "q": []}, "micro_hole_limit": 4, "contour_low_passes": 4, "compact_contour_low_passes": 2, "negative_space_kernel": 3, "negative_space_hole_limit": 9, "negative_space_closed_pixels": 0, "negative_space_holes_filled": 0,
}
NIGHT = COMMON | {
    "archetype": "night-landscape", "curve_model": "periodic cubic B-spline", "gap_closure_kernel": 3, "gap_pixels_closed": 0, "seam_underlap_added_pixels": {"foreground-light": 3}, "internal_contour_policy": "tips rounded",
    "internal_rounding_kernels": {"foreground-light": 3}, "internal_edge_snap_pixels": {"foreground-light": 0},
}
MIRROR = COMMON | {"archetype": "reflective-horizontal-landscape", "reflection_score": 0.8}


def document(names, path=PATH):
    return SVG.format(fields="".join(f'<path id="{n}" d="{path}"/>' for n in names), rects=RECTS)


KINDS = {"general": (document("pq"), GENERAL), "night": (document(["foreground-silhouette", "foreground-light"]), NIGHT), "mirror": (document("pq"), MIRROR)}
#: rule: (kind, keys of the plan to change), or (kind, text of the document, its replacement)
MUTATIONS = {
    "analysis_dimensions_match": ("general", {"width": 11}), "analysis_omits_private_quadrant_confidence": ("general", {"quadrant_scores": 1}), "analysis_declares_svg_renderer": ("general", {"renderer": "canvas"}),
    "analysis_records_clipped_frame_bleed": ("general", {"frame_edge_policy": "none"}), "analysis_shape_count_matches": ("general", {"shape_count": 3}), "analysis_point_count_matches": ("general", {"point_count": 1}),
    "analysis_color_mode_is_valid": ("general", {"color_mode": "neon"}), "analysis_archetype_is_valid": ("general", {"archetype": "abstract"}), "analysis_records_curve_smoothing": ("general", {"curve_smoothing": 1.2}),
    "analysis_records_gradient_strength": ("general", {"gradient_strength": -1}), "analysis_records_negative_gap_floor": ("general", {"min_negative_gap": 0.2}), "analysis_gradient_count_matches": ("general", {"gradient_count": 2}),
    "analysis_paper_style_is_valid": ("general", {"paper_style": "glossy"}), "analysis_paper_density_is_valid": ("general", {"paper_density": 9}), "analysis_grain_overlay_is_valid": ("general", {"grain_overlay": 2}),
    "analysis_vector_particle_count_matches": ("general", {"particle_count": 4}), "analysis_noise_layer_matches": ("general", {"paper": 0}), "analysis_records_compact_salient_islands": ("general", {"compact_salient_island_count": 2}),
    "analysis_records_focal_support_fields": ("general", {"focal_support_field_area_fractions": [0.1]}), "analysis_records_perspective_accent_lines": ("general", {"perspective_accent_line_area_fractions": None}),
    "general_fields_report_seam_underlap": ("general", {"seam_underlap_added_pixels": {"p": 1}}), "general_fields_bleed_past_touched_frame_edges": ("general", {"frame_edges": {"p": []}}), "general_fields_report_micro_hole_cleanup": ("general", {"micro_hole_limit": None}),
    "night_landscape_has_reduced_shape_budget": ("night", "</g><g id=", '<path id="x" d="M 0 0 C 1 1 2 2 3 3 Z"/><path id="y" d="M 0 0 C 1 1 2 2 3 3 Z"/></g><g id='), "night_landscape_declares_spline_fitter": ("night", {"curve_model": "adaptive"}),
    "reflective_fields_report_measured_pairing": ("mirror", {"reflection_score": 0.5}), "source_mode_preserves_sampled_palette": ("general", {"palette": ["#1", "#3"]}), "source_palette_reports_diverse_roles": ("general", {"palette_population_fractions": [0.4, 0.5]}),
    "traditional_grain_overlay_matches": ("general", {"grain_overlay": 0.0}), "traditional_grain_overlay_is_topmost": ("general", '<rect id="surface-grain" filter="url(#f)"/>', '<rect id="surface-grain" filter="url(#f)"/><rect fill="#111"/>'),
    "analysis_paper_texture_model_is_valid": ("general", {"paper_texture_model": "vector particles"}), "rough_paper_uses_three_vector_scales": ("general", 'fill="#222"', 'fill="#111"'), "general_fields_use_light_contour_low_pass": ("general", {"contour_low_passes": 2}),
    "general_fields_report_discarded_region_merge": ("general", {"merged_pixels": {"p": 1, "q": -1}}), "general_fields_report_negative_space_consolidation": ("general", {"negative_space_kernel": 4}), "general_fields_report_unrepresented_hole_merge": ("general", {"unrepresented_holes": {"p": 1, "q": 0, "r": 0}}),
    "general_fields_report_chromatic_false_background_merge": ("general", {"false_background_pixels": None}), "night_landscape_curve_segments_are_minimal": ("night", PATH, "M 0 0 " + "C 1 1 2 2 3 3 " * 133 + "Z"),
    "night_landscape_reports_gap_closure": ("night", {"gap_closure_kernel": 2}), "night_landscape_reports_seam_overlap": ("night", {"seam_underlap_added_pixels": None}), "night_landscape_regularizes_internal_contours": ("night", {"internal_edge_snap_pixels": {"foreground-light": -1}}),
}


def test_each_plan_rule_fails_on_its_own_mutation(spark):
    rules = validate.plan_rules()
    assert len(rules) == 41 and set(MUTATIONS) == set(rules)
    rows = [(f"good-{k}", svg, json.dumps(plan)) for k, (svg, plan) in KINDS.items()]
    for rule, (kind, *change) in MUTATIONS.items():
        svg, plan = KINDS[kind][0], copy.deepcopy(KINDS[kind][1])
        if len(change) == 1:
            plan |= change[0]
            plan = {k: v for k, v in plan.items() if v is not None}
        else:
            assert change[0] in svg
            svg = svg.replace(*change)
        rows.append((rule, svg, json.dumps(plan)))
    nothing = {k: v for k, v in GENERAL.items() if not k.startswith("false_background")}  # nothing was merged, so nothing is said
    rows.append(("good-silent", KINDS["general"][0], json.dumps(nothing)))
    docs = spark.createDataFrame(rows, "k string, svg string, plan string").withColumn("plan", F.try_parse_json("plan"))
    reports = validate.reports(validate.validated(validate.measured(docs), "k", rules), "k").collect()
    failed = {r.k: r.failed_checks.split(";") for r in reports}
    assert {k: v for k, v in failed.items() if k.startswith("good") and v != [""]} == {}
    assert {k for k in MUTATIONS if k not in failed[k]} == set()
