import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import color, scalars
from pixelloom.operators import aggregates, detect, document, geometry, joins, masks, palette, regions, stencils, validate
from pixelloom.operators import components as K
from pixelloom.plans.abstraction import abstraction
from pixelloom.plans.options import Options
from pixelloom.sources import catalog, raster


def mask_of(spark, text, image=0):
    rows = [(image, y, x) for y, line in enumerate(text.split()) for x, c in enumerate(line) if c == "#"]
    lines = text.split()
    return spark.createDataFrame(rows, "image_id long, y int, x int"), spark.createDataFrame([(image, len(lines[0]), len(lines))], "image_id long, width int, height int")


def drawn(df, like):
    lines = like.split()
    grid = [["."] * len(lines[0]) for _ in lines]
    for r in df.collect():
        grid[r.y][r.x] = "#"
    return ["".join(g) for g in grid]


def pixels_of(spark, array, image=0):
    h, w, _ = array.shape
    return spark.createDataFrame([(image, y, x, *map(int, array[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")


# ---------------------------------------------------------------- colour and scalars
def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_colour(spark):
    rgb = [F.lit(v) for v in (200, 100, 30)]
    lab = color.oklab(*rgb)
    r = one(spark, color.rgb_hex(F.lit(300), F.lit(-4), F.lit(15.9)), color.from_oklab(lab), color.from_oklab([F.lit(0.9), F.lit(0.4), F.lit(0.0)]), color.grey(*rgb), color.star_color(F.lit(100)))
    assert r[0] == "#FF000F" and tuple(r[1]) == (200, 100, 30) and r[2] is None and r[3] == 122 and r[4] == 143
    r = one(spark, color.balanced(F.lit(255), F.lit(0), F.lit(0)), color.balanced(F.lit(0), F.lit(0), F.lit(0)), color.output_color(*rgb, "source"), color.output_color(*rgb, "curated-night", F.lit("sky")), color.hue_cosine(lab, lab), color.oklab_distance(lab, lab))
    assert max(r[0]) < 255 and min(r[1]) >= 0 and r[1] != (0, 0, 0) and tuple(r[2]) == (200, 100, 30) and tuple(r[3]) == (21, 25, 24)
    assert abs(r[4] - 1) < 1e-9 and r[5] == 0


def test_scalars(spark):
    r = one(
        spark, scalars.dimension(F.lit("12px")), scalars.dimension(F.lit("12em")), scalars.path_bounds(F.lit("M 1 2 C -3 4.5 5 6e1 7 8 Z")), scalars.path_bounds(F.lit("M 1 2 3")), scalars.line_distance(*map(F.lit, (0.0, 1.0, 0.0, 0.0, 0.0, 0.0))),
        scalars.bleed_margin(F.lit(1000), F.lit(520)), scalars.underlap(F.lit(100), F.lit(100), F.lit(0.0)), scalars.shortened(F.lit("one  two three"), 9), scalars.xml_escape(F.lit("<a&b>")), scalars.fixed(F.lit(1.005), 1), F.size(scalars.star_points(*map(F.lit, (0.0, 0.0, 2.0, 1.0)))),
    )
    assert (r[0], r[1], tuple(r[2]), r[3], r[4], r[5], tuple(r[6])) == (12, None, (-3.0, 2.0, 7.0, 60.0), None, 1.0, 6, (0, 0, 1, 1))
    assert r[7:] == ("one two…", "&lt;a&amp;b&gt;", "1.0", 16)
    edges = F.array(F.lit("left"), F.lit("top"))
    b = scalars.path_bounds(F.lit("M -1 -1 L 5 5"))
    assert tuple(one(spark, scalars.bleeds(b, edges, F.lit(5), F.lit(5)), scalars.bleeds(b, F.array(F.lit("right")), F.lit(5), F.lit(5)), scalars.bleeds(scalars.path_bounds(F.lit("")), edges, F.lit(5), F.lit(5)))) == (True, False, False)
    assert one(spark, scalars.is_comparison(F.lit("x/comparisons/a.jpg"), [".jpg"], ["cmp"]), scalars.is_comparison(F.lit("a.jpg"), [".jpg"], ["cmp"]))[:] == (True, False)


# ---------------------------------------------------------------- components and masks
TWO = "##.... ##.... ..##.. ..##.. ...... ......"
RING = "....... .#####. .#...#. .#...#. .#...#. .#####. ......."


def test_islands_that_touch_diagonally_stay_two(spark):
    m, _ = mask_of(spark, TWO)
    assert sorted(r.area for r in K.measures(K.components(m)).collect()) == [4, 4]


def test_random_components_against_flood_fill(spark):
    rnd = np.random.default_rng(5)
    grid = rnd.random((40, 37)) < 0.55
    m = spark.createDataFrame([(7, int(y), int(x)) for y, x in zip(*np.nonzero(grid), strict=True)], "image_id long, y int, x int")
    seen, want = np.zeros_like(grid), {}
    for y, x in zip(*np.nonzero(grid), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < 40 and 0 <= d < 37 and grid[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        for c in cells:
            want[c] = y * K.WIDE + x
    assert {(r.y, r.x): r.component for r in K.components(m).collect()} == want


def test_holes_and_floods(spark):
    m, f = mask_of(spark, RING)
    assert K.holes(m, f).count() == 9 and K.filled(m, f, most=8).count() == 16 and K.filled(m, f).count() == 25
    leaky, f2 = mask_of(spark, RING.replace(".#####. .#...#.", ".##.##. .#...#.", 1))
    assert K.holes(leaky, f2).count() == 0
    land, f3 = mask_of(spark, "........ ..##.... ........ ........ .####... #.......")
    assert drawn(K.bottom_connected(land, f3), "........ " * 6)[4:] == [".####...", "########"]
    assert K.below_sky(m, f).count() == 25


def test_mask_algebra_and_edges(spark):
    a, f = mask_of(spark, TWO)
    b, _ = mask_of(spark, "#..... #..... ...... ..##.. ...... .....#")
    assert (masks.union(a, b).count(), masks.intersection(a, b).count(), masks.difference(a, b).count(), masks.complement(a, f).count()) == (9, 4, 4, 28)
    assert masks.touched_edges(b, f).first().edges == ["left", "right", "top", "bottom"]


def test_morphology_against_windows(spark):
    rnd = np.random.default_rng(2)
    grid = rnd.random((17, 23)) < 0.5
    m = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(grid), strict=True)], "image_id long, y int, x int")
    f = spark.createDataFrame([(0, 23, 17)], "image_id long, width int, height int")

    def window(g, k, how):
        return np.array([[how(g[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]) for x in range(23)] for y in range(17)])

    def grid_of(df):
        out = np.zeros_like(grid)
        for r in df.collect():
            out[r.y, r.x] = True
        return out

    assert (grid_of(stencils.dilated(m, 3, f)) == window(grid, 1, np.any)).all()
    assert (grid_of(stencils.eroded(m, 3, f)) == window(grid, 1, np.all)).all()
    assert (grid_of(stencils.cleaned(m, 3, 3, f)) == window(window(window(grid, 1, np.any), 1, np.all), 1, lambda w: w.sum() * 2 > w.size)).all()


def test_gaussian_keeps_flat_and_sums(spark):
    flat = pixels_of(spark, np.full((6, 6, 3), 9))
    assert all(abs(r.r - 9) < 1e-9 for r in stencils.gaussian(flat, "r", 1.2).collect())


# ---------------------------------------------------------------- joins, ranking, regions
def test_owner_tie_goes_to_first(spark):
    parts, f = mask_of(spark, "..... .#... .....")
    owners = spark.createDataFrame([(0, 1, 0, 5), (0, 1, 2, 3), (0, 0, 1, 9), (0, 2, 1, 9)], "image_id long, y int, x int, owner int")
    touch = joins.contacts(parts.withColumn("component", F.lit(1)), owners)
    assert joins.best_owner(touch, F.lit(0.0)).first().owner == 9
    assert joins.best_owner(touch.where("owner < 9"), F.lit(0.0)).first().owner == 3


def test_spacing_is_greedy(spark):
    rnd = random.Random(3)
    pts = [(0, x, y, rnd.random()) for x in range(25) for y in range(25)]
    kept = []
    for p in sorted(pts, key=lambda p: (-p[3], p[2], p[1])):
        if all(math.dist(p[1:3], q[1:3]) >= 4 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(pts, "image_id long, x int, y int, score double")
    assert sorted(tuple(r) for r in joins.spaced(df, 4.0, "score").collect()) == sorted(kept)


def test_budget(spark):
    rows = [(0, c, lab, a, 0.0, float(y), s) for c, lab, a, y, s in ((1, 0, 50, 3, 0.1), (2, 0, 40, 1, 0.9), (3, 1, 10, 2, 0.2), (4, 1, 9, 0, 0.8), (5, 0, 8, 5, 0.05))]
    df = spark.createDataFrame(rows, "image_id long, component long, label int, area long, cx double, cy double, score double")
    assert [r.component for r in regions.within_budget(df, 3).orderBy("paint").collect()] == [2, 3, 1]
    assert [r.component for r in regions.within_budget(df, 3, paint_last=[0]).orderBy("paint").collect()] == [3, 2, 1]


def test_slivers_and_holes_of_fields(spark):
    left, f = mask_of(spark, "####.### " * 5)
    fields = left.withColumn("owner", F.when(F.col("x") < 4, 1).otherwise(2))
    new = regions.negative_space(fields, f, 3).collect()
    assert {(r.y, r.x) for r in new} == {(y, 4) for y in range(5)} and {r.owner for r in new} == {1}
    ring, f2 = mask_of(spark, RING)
    none = ring.limit(0)
    assert regions.unclaimed_holes(ring, none, none, f2).count() == 9
    assert regions.unclaimed_holes(ring, none, K.holes(ring, f2), f2).count() == 0
    edge, f3 = mask_of(spark, "##.. .... ....")
    assert regions.bled(edge, f3, 2).count() == 12


def test_quadrants_and_palette(spark):
    a = np.zeros((12, 16, 3), int)
    a[:, :10], a[:, 10:14], a[:, 14:] = (30, 40, 90), (120, 120, 120), (220, 60, 40)
    px = pixels_of(spark, a)
    labelled, roles = palette.quantised(px, 4)
    got = {r.label: (r.r, r.g, r.b) for r in roles.collect()}
    assert got == {0: (30, 40, 90), 1: (220, 60, 40), 2: (120, 120, 120)}
    assert {(r.x < 10, r.label) for r in labelled.where("x < 14").collect()} == {(True, 0), (False, 2)}
    flat = palette.quantised(pixels_of(spark, np.full((4, 4, 3), 7)), 6)[1].collect()
    assert [(r.label, r.r) for r in flat] == [(0, 7)]
    assert aggregates.edge_mode(labelled, raster.frames(px)).first().background == 0


# ---------------------------------------------------------------- geometry
def circle(bump=1.0):
    t = np.arange(64) * 2 * np.pi / 64
    r = np.full(64, 30.0)
    r[0] *= bump
    return np.stack([r * np.cos(t), r * np.sin(t)], 1) + 40


def test_micro_filter_moves_notches_not_peaks():
    notch, peak, plain = (geometry.without_roughness(circle(b), 0.82) for b in (1.08, 1.35, 1.0))
    assert np.hypot(*(notch[0] - circle(1.08)[0])) > 0.5 and np.hypot(*(peak[0] - circle(1.35)[0])) < 1e-9 and np.abs(plain - circle()).max() < 0.2
    assert (geometry.without_roughness(circle()[:8], 0.82) == circle()[:8]).all()


def test_outlines_and_paths(spark):
    m, _ = mask_of(spark, RING)
    parts = K.components(m)
    edges = regions.boundary_edges(parts)
    out = geometry.outline_table(edges).collect()
    assert {r.loop for r in out} == {0, 1} and len(out) == 20 + 12
    path = geometry.path_table(edges).first().path
    assert path.count("M ") == 2 and path.count("Z") == 2 and "C " in path
    ring = geometry.per_loop(geometry.outline_table(edges), "component", lambda p: geometry.resampled(p, 10))
    assert ring.count() == 20
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert np.allclose(geometry.resampled(square, 8)[1], [2, 0]) and geometry.curve(square[:2]) == ""
    assert geometry.curve(square, mode="bspline").startswith("M ") and len(geometry.simplified(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2
    spline = geometry.spline_path(square)
    assert spline.count("C ") == 4


def test_contour_follows_best_rows():
    s = np.zeros((20, 12))
    for x in range(12):
        s[5 + x // 3, x] = 1
    assert geometry.contour_by_columns(s, 4).tolist() == [5 + x // 3 for x in range(12)]
    assert len(geometry.contour_by_columns(np.full((4, 3), -1.0), 4)) == 3


def test_gradient_axis(spark):
    a = np.zeros((20, 20, 3), int)
    a[..., 1] = (np.arange(20) * 8)[None, :]
    px = pixels_of(spark, a).withColumn("label", F.lit(0))
    g = geometry.source_gradients(px, ["image_id", "label"], raster.frames(px)).first()
    assert g.axis == "horizontal" and g.stops[0].g < g.stops[1].g < g.stops[2].g
    assert geometry.source_gradients(px.where("x < 3"), ["image_id", "label"], raster.frames(px)).count() == 0


# ---------------------------------------------------------------- detectors
def test_reflection_and_night(spark):
    h, w = 20, 40
    y, x = np.mgrid[0:h, 0:w]
    d = np.where(y < h // 2, y, h - 1 - y)
    base = 40 + 18 * d + 40 * (np.sin(x / 3) > 0) * (d > 4)
    mirror = np.clip(np.stack([base, base * 0.8, 230 - base * 0.7], 2), 0, 255).astype(int)
    px = pixels_of(spark, mirror)
    got = detect.reflection(px, raster.frames(px)).first()
    assert got.axis == 10 and got.light > 0.95
    dark = np.zeros((20, 20, 3), int)
    dark[...] = (20, 22, 40)
    dark[12:] = (90, 60, 30)
    assert detect.night_gate(pixels_of(spark, dark)).first().night and not detect.night_gate(px).first().night


def test_accent_line(spark):
    a = np.full((60, 60, 3), 90)
    for y in range(32, 60):
        x = 30 + (y - 32) // 14
        a[y, x : x + 2] = (255, 200, 40)
    px = pixels_of(spark, a)
    f = raster.frames(px)
    found = detect.accent_line(px, f)
    got = found.first()
    assert got is not None and got.y1 == 59 and 0 < got.slope < 0.2
    assert detect.ribbon(found, f).count() > 28
    assert detect.accent_line(pixels_of(spark, np.full((60, 60, 3), 90)), f).count() == 0


def test_focal_detectors_run_on_plain_and_marked_images(spark):
    a = np.full((40, 48, 3), 120)
    a[18:23, 20:25] = (250, 240, 60)
    px = detect.with_oklab(pixels_of(spark, a)).withColumn("label", F.lit(0))
    f = raster.frames(px)
    got = detect.compact_island(px, f).first()
    assert got.kind == "local-contrast"
    for found in (detect.silhouette, detect.cool_shore, detect.perspective_corridor):
        assert found(px.select("image_id", "y", "x", "r", "g", "b"), f).count() == 0


def test_corridor_is_dark_and_between_its_edges(spark):
    def road(ground, verge):
        a = np.full((80, 80, 3), 200)
        a[40:] = verge
        for y in range(40, 80):
            t = ((y - 40) / 39) ** 0.88
            a[y, round(38 - 36 * t) : round(41 + 36 * t)] = ground
        return a

    for ground, verge, n in ((40, 150, 1), (200, 90, 0)):  # a light road between dark verges is none
        px = pixels_of(spark, road(ground, verge))
        f = raster.frames(px)
        found = detect.perspective_corridor(px, f)
        assert found.count() == n
        if n:
            r = found.first()
            assert 34 <= r.vx <= 46 and 33 <= r.vy <= 45 and r.lx < 16 and r.rx > 60
            mask = {(m.y, m.x) for m in detect.corridor_mask(found, f).collect()}
            assert (79, 40) in mask and (79, r.lx) in mask and (79, r.lx - 1) not in mask and min(y for y, _ in mask) == r.vy


def test_silhouette_is_dark_only_and_ends_below_the_horizon(spark):
    def scene_of(subject):
        a = np.full((100, 100, 3), 190)
        a[60:] = (120, 140, 170)  # horizon to the right of the subject at row 60
        a[35:88, 38:58] = subject
        return a

    px = pixels_of(spark, scene_of(20))
    f = raster.frames(px)
    got = {(r.y, r.x) for r in detect.silhouette(px, f).collect()}
    rows = [y for y, _ in got]
    assert (45, 48) in got and min(rows) <= 37 and 60 < max(rows) <= 72
    assert detect.silhouette(pixels_of(spark, scene_of(250)), f).count() == 0


def test_cool_shore_is_below_a_warm_foreground(spark):
    a = np.full((100, 100, 3), 150)
    a[46:64, 20:] = (90, 120, 210)
    a[64:, 40:] = (90, 120, 210)
    a[60:, :40] = (210, 150, 70)
    px = pixels_of(spark, a)
    f = raster.frames(px)
    got = {(r.y, r.x) for r in detect.cool_shore(px, f).collect()}
    assert (55, 90) in got and (90, 70) in got and (80, 10) not in got and (20, 90) not in got
    assert detect.cool_shore(pixels_of(spark, a[:, ::-1]), f).count() == 0  # cool left and warm right


def test_highlights_score_space_and_size(spark):
    rnd = np.random.default_rng(0)
    a = np.full((100, 300, 3), 30)
    spots = [(y, x) for y in range(5, 80, 12) for x in range(5, 295, 12)]
    for y, x in spots[:60]:
        a[y, x] = int(rnd.integers(150, 250))
        a[y, x + 1] = 140
    px = pixels_of(spark, a)
    got = document.highlights(px, raster.frames(px)).orderBy("n").collect()
    assert len(got) == 32 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert all(0.70 + 1.2 * 0.25 - 0.13 <= r.r <= 0.70 + 1.2 + 0.13 for r in got)
    assert all((p.x - q.x) ** 2 + (p.y - q.y) ** 2 >= 16 for p in got for q in got if p is not q)
    assert all(a[r.y, r.x].max() >= 150 for r in got)


# ---------------------------------------------------------------- documents, validation, sources
def test_options():
    assert Options().palette_size == 6
    for bad in ({"width": 100}, {"detail": 2}, {"color_mode": "x"}, {"grain_overlay": 0.5}, {"max_shapes": 2}):
        with pytest.raises(ValueError, match="must|needs"):
            Options(**bad)


def scene():
    rnd = np.random.default_rng(1)
    a = np.zeros((48, 64, 3), int)
    a[:20], a[20:34], a[34:] = (150, 180, 220), (90, 120, 80), (60, 50, 40)
    a[26:40, 40:56] = (200, 120, 60)
    return np.clip(a + rnd.integers(-4, 5, a.shape), 0, 255)


def test_documents_pass_the_structural_rules(spark):
    out = abstraction(pixels_of(spark, scene(), image=3), Options(palette_size=4, max_shapes=8, paper_style="rough", width=640)).select("image_id", "svg", F.try_parse_json("plan").alias("plan")).cache()
    doc = validate.measured(out)
    checks = validate.validated(doc, "image_id", validate.structural_rules())
    assert (doc.first().svg_width, doc.first().svg_height) == (640, 480)
    assert validate.reports(checks, "image_id").first().failed_checks == ""
    plan = {r.check: r.passed for r in validate.validated(doc, "image_id", validate.plan_rules()).collect()}
    for name in ("analysis_dimensions_match", "analysis_omits_private_quadrant_confidence", "analysis_shape_count_matches", "analysis_gradient_count_matches", "analysis_color_mode_is_valid", "analysis_archetype_is_valid", "general_fields_bleed_past_touched_frame_edges"):
        assert plan[name], name
    again = abstraction(pixels_of(spark, scene(), image=3).repartition(7), Options(palette_size=4, max_shapes=8, paper_style="rough", width=640))
    assert again.first().svg == out.first().svg


GOOD = '<svg xmlns="http://www.w3.org/2000/svg" width="10" height="8" viewBox="0 0 10 8" overflow="hidden"><defs><linearGradient id="a"><stop/><stop/><stop/></linearGradient></defs><g id="source-derived-fields"><path id="p" d="M 0 0 C 1 1 2 2 3 3 Z"/><path id="q" d="M 0 0 C 1 1 2 2 3 3 Z"/></g><g id="surface-noise-layer"><rect/></g></svg>'


def test_each_rule_fails_on_its_own_mutation(spark):
    changes = {
        "positive_dimensions": ('width="10"', 'width="0"'), "viewbox_matches_dimensions": ("0 0 10 8", "0 0 10 9"), "root_clips_frame_bleed": ("hidden", "visible"), "contains_no_embedded_or_canvas_content": ("<defs>", "<defs><image/>"),
        "all_paths_have_geometry": ('id="q" d="M 0 0 C 1 1 2 2 3 3 Z"', 'id="q" d=""'), "structural_paths_use_cubic_curves": ("C 1 1 2 2 3 3 Z\"/></g>", "L 1 1 Z\"/></g>"), "surface_noise_layer_is_topmost": ("</svg>", "<g/></svg>"),
        "source_gradients_have_three_stops": ("<stop/><stop/><stop/>", "<stop/>"), "source_gradient_ids_are_unique": ("</defs>", '<linearGradient id="a"><stop/><stop/><stop/></linearGradient></defs>'), "has_source_derived_paths": ('<path id="q" d="M 0 0 C 1 1 2 2 3 3 Z"/>', ""), "root_is_svg": ("svg", "svx"),
    }
    rows = [("good", GOOD)] + [(k, GOOD.replace(a, b)) for k, (a, b) in changes.items()]
    docs = validate.measured(spark.createDataFrame(rows, "k string, svg string"))
    failed = {r.k: r.failed_checks.split(";") for r in validate.reports(validate.validated(docs, "k", validate.structural_rules()), "k").collect()}
    assert failed["good"] == [""]
    for k in changes:
        assert k in failed[k], (k, failed[k])


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in r for v in px) for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_resizing(spark, tmp_path):
    png(tmp_path / "a.png", [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 11, 12), (13, 14, 15), (255, 0, 128)]])
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in raster.read_images(spark, str(tmp_path)).collect()}
    assert got[0, 0] == (1, 2, 3) and got[1, 2] == (255, 0, 128) and len(got) == 6
    assert raster.list_images(spark, str(tmp_path)).count() == 2
    flat = raster.resized(pixels_of(spark, np.full((12, 24, 3), 77)), 8)
    assert flat.count() == 8 * 4 and {r.r for r in flat.collect()} == {77}
    a = np.arange(6).reshape(2, 3)[..., None]
    assert raster.upright(a, 6).shape[:2] == (3, 2) and raster.upright(a, 6)[0, 0, 0] == 3 and raster.upright(a, 3)[0, 0, 0] == 5


def test_catalogues(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (tmp_path / "in" / n).write_text(t)
    sums = catalog.checksums(spark, str(tmp_path / "in"))
    assert sums.select("sha256").distinct().count() == 2
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", F.lit("g").alias("group"), F.col("modificationTime").alias("modified"), "content")
    rows = {r.path.rsplit("/", 1)[1]: r for r in catalog.review(files).collect()}
    first = min(rows["a.txt"].id, rows["b.txt"].id)
    assert {rows["a.txt"].duplicate_of, rows["b.txt"].duplicate_of} == {None, first} and rows["c.txt"].duplicate_of is None
    runs = spark.createDataFrame([("001", "d", "s", "v", "a", "p", "c", "PASS", "", "general", 5, 1.5), ("002", "d", "s", "v", "a", "p", "c", "FAIL", "x;y", "general", 3, 2.0)], catalog.RUN_MANIFEST)
    catalog.write_manifest(runs, str(tmp_path / "m"))
    assert tuple(catalog.run_summary(catalog.read_manifest(spark, str(tmp_path / "m"))).first()) == ("d", 2, 1, 8, 3.5)
    with pytest.raises(Exception, match="(?i)exists"):
        catalog.write_manifest(runs, str(tmp_path / "m"))
    (tmp_path / "setup.cfg").write_text("[metadata]\nversion = 1.2.3\n")
    assert catalog.ini_value(spark, str(tmp_path / "setup.cfg"), "version").first()[0] == "1.2.3"
    docs = spark.createDataFrame([(1, "<svg/>")], "image_id long, svg string")
    document.write_texts(docs, "svg", str(tmp_path / "svgs"))
    assert catalog.read_svgs(spark, str(tmp_path / "svgs/*")).first().svg.strip() == "<svg/>"
    keys = spark.createDataFrame([(1, '{"A": {"b": [ {"C": 1} ]}}'), (2, "no")], "k int, j string")
    assert {r.name for r in validate.nested_keys(keys, "k", "j").collect()} == {"a", "b", "c"}


def test_weaker_islands(spark, monkeypatch):
    a = np.full((60, 80, 3), 128)
    a[:, 40:] = (70, 70, 70)
    a[26:32, 37:44] = (185, 110, 60)
    px = detect.with_oklab(pixels_of(spark, a)).withColumn("label", F.when(F.col("x") < 40, 0).otherwise(1))
    f = raster.frames(px)
    got = detect.cross_field_island(px, f).collect()
    assert [(r.kind, r.component // K.WIDE) for r in got] == [("cross-field", 26)]
    monkeypatch.setitem(detect._RARE, "area", (0.001, 0.05))  # a patch that fills its percentile is larger than usual here
    soft = np.full((80, 120, 3), 128)
    soft[20:34, 20:34] = (160, 112, 108)  # rare by its distance from the image's median hue, not by a broad blur
    px2 = detect.with_oklab(pixels_of(spark, soft)).withColumn("label", F.when(F.col("x") < 26, 0).otherwise(1))
    rare = detect.rare_chromatic_island(px2, raster.frames(px2)).collect()
    assert [(r.kind, r.satellites) for r in rare] == [("rare-chromatic", [])]
    plain = detect.with_oklab(pixels_of(spark, np.full((60, 80, 3), 128))).withColumn("label", F.lit(0))
    assert detect.focal_island(plain, f).count() == 0


def test_low_pass_of_tables_holds_a_fixed_number_of_values_a_row(spark):
    sizes = {None: 7, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 40}
    rows = [(g, i, float((i * 7 + n) % 11), float(i * i % 5)) for g, n in sizes.items() for i in range(n)]
    out = geometry.low_passed(spark.createDataFrame(rows, "g int, i int, x double, y double").repartition(3), ["g"], ["i"])
    assert out.columns == ["g", "i", "x", "y"]
    got = {(r.g, r.i): (r.x, r.y) for r in out.collect()}
    assert len(got) == len(rows)
    for g, n in sizes.items():
        want = geometry.low_pass(np.array([r[2:] for r in rows if r[0] == g]), 0.82)
        assert np.allclose([got[g, i] for i in range(n)], want)
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_numbers_in_order_over_many_ranges(spark):
    rows = [(f"k{i * 7919 % 1200:05d}",) for i in range(1200)]
    got = raster.numbered(spark.createDataFrame(rows, "k string").repartition(5), "k").collect()
    assert sorted((r.id, r.k) for r in got) == [(i + 1, k) for i, (k,) in enumerate(sorted(rows))]
    ids = spark.createDataFrame([(7,), (1234,), (None,)], "n int").select(scalars.padded_id(F.col("n")).alias("id"))
    assert [r.id for r in ids.collect()] == ["007", "1234", None]
