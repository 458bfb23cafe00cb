import contextlib
import io
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import coverage, detect, geometry, joins, masks, regions, validate
from pixelloom.operators import components as K


def cubic(p, t):
    u = 1 - t
    return p[0] * u**3 + 3 * p[1] * u * u * t + 3 * p[2] * u * t * t + p[3] * t**3


def dense(path, width, height):
    """Pixels whose centre a dense polyline of the path winds around oddly, by crossings to the left."""
    inside = np.zeros((height, width), bool)
    for part in filter(str.strip, path.split("Z")):
        n = np.array([float(v) for v in re.findall(r"-?[0-9.]+", part)])
        pts = [n[:2]]
        for k in range(2, len(n) - 5, 6):
            c = np.array([pts[-1], n[k : k + 2], n[k + 2 : k + 4], n[k + 4 : k + 6]])
            pts += [cubic(c, (i + 1) / coverage.PIECES) for i in range(coverage.PIECES)]
        for (x0, y0), (x1, y1) in zip(pts, [*pts[1:], pts[0]], strict=True):
            for y in range(height):
                if (y0 <= y + 0.5) != (y1 <= y + 0.5):
                    x = x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0)
                    inside[y] ^= np.arange(width) + 0.5 >= x
    return inside


def blobs(seed, size=24):
    rng = np.random.default_rng(seed)
    return [(i, int(y), int(x)) for i in range(2) for y in range(size) for x in range(size) if np.sin(x / 3.1 + i) + np.cos(y / 2.7 - i) + rng.normal(0, 0.2) > 0.4]


def test_curves_fill_what_a_dense_polyline_fills(spark):
    mask = spark.createDataFrame(blobs(1), "image_id long, y int, x int")
    frames = spark.createDataFrame([(0, 24, 24), (1, 24, 24)], "image_id long, width int, height int")
    parts = K.stored(K.components(mask))
    paths = K.stored(geometry.path_table(regions.boundary_edges(parts)))
    lines = coverage.flattened(coverage.segments(paths, "component"), "component")
    drawn = coverage.covered_pixels(coverage.scan_filled(lines, "component"), "component", frames)
    got = {}
    for r in drawn.collect():
        got.setdefault((r.image_id, r.component), set()).add((r.y, r.x))
    report = {(r.image_id, r.component): r for r in coverage.audit(parts, drawn, "component").collect()}
    fields = {}
    for r in parts.collect():
        fields.setdefault((r.image_id, r.component), set()).add((r.y, r.x))
    assert len(paths.collect()) > 3
    for r in paths.collect():
        want = {(int(y), int(x)) for y, x in zip(*np.nonzero(dense(r.path, 24, 24)), strict=True)}
        key = r.image_id, r.component
        assert got.get(key, set()) == want
        assert (report[key].pixels, report[key].covered, report[key].lost, report[key].leaked) == (len(fields[key]), len(want), len(fields[key] - want), len(want - fields[key]))


def test_segments_without_text_are_those_of_the_paths(spark):
    mask = spark.createDataFrame(blobs(2, 40) + [(0, 60, 3), (0, 60, 5), (0, 61, 4)], "image_id long, y int, x int")
    edges = K.stored(regions.boundary_edges(K.components(mask)))
    rows = lambda df: sorted((r.image_id, r.component, *r.p) for r in df.collect())
    read = [r for r in rows(coverage.segments(geometry.path_table(edges), "component")) if r[2:8] != r[4:10]]
    own = geometry.segment_table(edges)
    assert rows(own) == read and len(read) > 100
    fill = lambda df: sorted(map(tuple, coverage.scan_filled(coverage.flattened(df, "component"), "component").collect()))
    assert fill(coverage.crossing(own)) == fill(own) and coverage.crossing(own).count() < len(read) * 0.8
    assert geometry.segment_table(edges.limit(0)).count() == 0 and "Broadcast" not in plan(regions.boundary_edges(K.stored(K.components(mask))))


def test_small_parts_are_drawn_once(monkeypatch):
    calls = []
    drawn = geometry._drawn
    monkeypatch.setattr(geometry, "_drawn", lambda *a, **b: calls.append(1) or drawn(*a, **b))
    square = lambda name, x: [(name, x, 0, x + 1, 0), (name, x + 1, 0, x + 1, 1), (name, x + 1, 1, x, 1), (name, x, 1, x, 0)]
    pdf = pd.DataFrame(square(4, 901) + square(5, 907) + square(3, 901)[::-1], columns=["part", "ax", "ay", "bx", "by"])
    plain = {"tolerance": 0.9, "scale": (1.0, 1.0), "smoothing": 0.82, "budget": None, "mode": "adaptive"}
    got = dict(geometry._paths(pdf, "part", {}, plain))
    assert sorted(got) == [3, 4, 5] and got[3] == got[4] != got[5] and len(calls) == 2


def test_degenerate_paths_cover_nothing_and_holes_are_found(spark):
    rows = [(1, 1, None), (1, 2, ""), (1, 3, "M 1 1 Z"), (1, 4, "M 0 0 C 1 0 2 0 4 0 Z"), (1, 5, "M 1 1 C 1 3 1 5 1 7 C 3 7 5 7 7 7 C 7 5 7 3 7 1 Z M 3 3 C 3 4 3 4 3 5 C 4 5 4 5 5 5 C 5 4 5 4 5 3 Z"), (1, 6, "M -4 -4 C -4 1 -4 1 -4 2 C 1 2 1 2 2 2 C 2 -1 2 -1 2 -4")]
    paths = spark.createDataFrame([(*r, "w") for r in rows], "image_id long, part int, path string, width string")
    frames = spark.createDataFrame([(1, 10, 10)], "image_id long, width int, height int")
    drawn = coverage.covered_pixels(coverage.scan_filled(coverage.flattened(coverage.segments(paths, "part"), "part"), "part"), "part", frames)
    got = {}
    for r in drawn.collect():
        got.setdefault(r.part, set()).add((r.y, r.x))
    ring = {(y, x) for y in range(1, 7) for x in range(1, 7)} - {(y, x) for y in (3, 4) for x in (3, 4)}
    assert got == {5: ring, 6: {(0, 0), (0, 1), (1, 0), (1, 1)}}
    found = coverage.micro_holes(drawn, frames, 4).collect()
    assert [(r.image_id, r.area) for r in found] == [(1, 4)] and coverage.micro_holes(drawn, frames, 3).count() == 0
    assert coverage.segments(paths.limit(0), "part").count() == 0


def flooded(label, owner, ink, owner_label, protected):
    """Merges of one raster pixel by pixel, as the definition says: owner changes while the raster is read."""
    h, w = label.shape
    seen, out = np.zeros((h, w), bool), {}
    owner = owner.copy()
    for y0 in range(h):
        for x0 in range(w):
            if label[y0, x0] < 0 or owner[y0, x0] >= 0 or seen[y0, x0]:
                continue
            stack, part = [(y0, x0)], []
            seen[y0, x0] = True
            while stack:
                y, x = stack.pop()
                part.append((y, x))
                for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= a < h and 0 <= b < w and owner[a, b] < 0 and not seen[a, b] and label[a, b] == label[y0, x0]:
                        seen[a, b] = True
                        stack.append((a, b))
            count = {}
            for y, x in part:
                for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= a < h and 0 <= b < w and owner[a, b] >= 0:
                        count[owner[a, b]] = count.get(owner[a, b], 0) + 1
            if not count:
                near = {(a, b) for y, x in part for a in range(max(0, y - 3), min(h, y + 4)) for b in range(max(0, x - 3), min(w, x + 4)) if owner[a, b] >= 0}
                for a, b in near:
                    count[owner[a, b]] = count.get(owner[a, b], 0) + 1
            best = None
            for o, n in count.items():
                if owner_label[o] in protected and owner_label[o] != label[y0, x0]:
                    continue
                gap = sum(((ink[label[y0, x0]] - ink[owner_label[o]]) * k) ** 2 for k in (0.30, 0.59, 0.11)) ** 0.5 / 255
                score = (n / (1 + 2 * gap), n, -o)
                best = max(best, (score, o, n)) if best else (score, o, n)
            if best:
                for y, x in part:
                    owner[y, x] = best[1]
                out[y0, x0] = (int(best[1]), best[2], len(part))
    return out


@pytest.mark.parametrize("protected", [[], [2]])
def test_merges_in_reading_order(spark, protected):
    rng = np.random.default_rng(7)
    ink = {0: 20, 1: 90, 2: 160, 3: 230}
    lost, owned, frames, want, chosen = [], [], [], {}, []
    for image in range(3):
        label = np.kron(rng.integers(0, 4, (12, 12)), np.ones((2, 2), int))
        label[rng.random(label.shape) < 0.2] = -1
        owner = np.full(label.shape, -1)
        numbers = {}
        for k, (y, x) in enumerate([(2, 3), (14, 16), (20, 4)]):
            owner[y : y + 3, x : x + 3] = k
            label[y : y + 3, x : x + 3] = k + (k == 2)
            numbers[k] = int(label[y, x])
        frames.append((image, 24, 24))
        chosen += [(image, k, lab, ink[lab], ink[lab], ink[lab]) for k, lab in numbers.items()]
        for y in range(24):
            for x in range(24):
                (owned if owner[y, x] >= 0 else lost).append((image, y, x, int(label[y, x]), int(owner[y, x])))
        for (y, x), v in flooded(label, owner, ink, numbers, protected).items():
            want[image, y * K.WIDE + x] = v
    lost = spark.createDataFrame([r for r in lost if r[3] >= 0], "image_id long, y int, x int, label int, owner long").drop("owner")
    parts = K.stored(K.components(lost, "label"))
    owners = spark.createDataFrame(owned, "image_id long, y int, x int, label int, owner long")
    inks = parts.select("image_id", "component", "label").distinct().select("image_id", "component", *(F.element_at(F.create_map(*(F.lit(v) for kv in ink.items() for v in kv)), F.col("label")).alias(c) for c in "rgb"))
    owner_ink = spark.createDataFrame(chosen, "image_id long, owner long, label int, r int, g int, b int")
    frames = spark.createDataFrame(frames, "image_id long, width int, height int")
    merges = K.stored(regions.merged_in_order(parts, owners, frames, inks, owner_ink, protected))
    got = {(r.image_id, r.component): (r.owner, r.contacts) for r in merges.collect()}
    assert got == {k: v[:2] for k, v in want.items()} and len(got) > 40
    counts = {(r.image_id, r.owner): (r.components, r.pixels) for r in regions.merge_counts(merges, parts, owners).collect()}
    assert counts == {(i, o): (sum(1 for k, v in want.items() if k[0] == i and v[0] == o), sum(v[2] for k, v in want.items() if k[0] == i and v[0] == o)) for i in range(3) for o in range(3)}


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_tables_of_pixels_are_not_broadcast(spark):
    """Stored, they are small; they and what they explode to don't go through the driver."""
    pixel = spark.range(4096).select(F.lit(1).cast("long").alias("image_id"), *(F.expr(e).cast("int").alias(c) for e, c in (("id div 64", "y"), ("id % 64", "x"))), (F.col("id") % 7).alias("component"))
    parts, owners = K.stored(pixel), K.stored(pixel.withColumn("owner", F.col("component") + 7))
    sizes = parts.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))  # more bytes by Spark's estimate
    around = joins.dilated_by(parts.where("component = 1"), "component", 7, sizes)
    for df in (joins.contacts(parts, owners), around, joins.near_contacts(parts, owners, sizes)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    want = {(b, a) for i in range(1, 4096, 7) for y, x in [divmod(i, 64)] for b in range(max(0, y - 3), min(64, y + 4)) for a in range(max(0, x - 3), min(64, x + 4))}
    assert {(r.y, r.x) for r in around.collect()} == want and around.count() == len(want)
    merges = K.stored(joins.contacts(parts, owners).select("image_id", "component", "owner", "contacts"))
    assert "Broadcast" not in plan(regions.merge_counts(merges, parts, owners))


def test_masks_and_limits_of_images_are_not_broadcast(spark):
    pixel = spark.range(4096).select(F.lit(1).cast("long").alias("image_id"), *(F.expr(e).cast("int").alias(c) for e, c in (("id div 64", "y"), ("id % 64", "x"), ("id % 200", "v"), ("id % 90", "r"), ("id % 80", "g"), ("id % 70", "b"))))
    rows = K.stored(pixel)
    one, two = K.stored(rows.where("v < 90").select(masks.PIXEL)), K.stored(rows.where("v > 60").select(masks.PIXEL))
    claims = K.stored(one.withColumn("priority", F.lit(7)))
    for df in (masks.intersection(one, two), masks.difference(one, two), masks.overwritten(rows.withColumnRenamed("v", "label"), claims), masks.above_percentile(rows, "v", 0.5, 3), detect.night_gate(rows), joins.along(one.selectExpr("image_id", "y as line", "0 as x0", "0 as y0", "x as x1", "y as y1"), rows, "v")):
        assert "Broadcast" not in plan(df)
    assert masks.intersection(one, two).count() == rows.where("v > 60 and v < 90").count() and masks.difference(one, two).count() == rows.where("v <= 60").count()


def test_surroundings_end_at_the_frame(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, -3, 2, 6), (1, -4, 2, 7), (1, 2, 11, 8), (2, 0, 0, 9)], "image_id long, y int, x int, component long")
    frames = spark.createDataFrame([(1, 8, 4)], "image_id long, width int, height int")
    got = {(r.component, r.y, r.x) for r in joins.dilated_by(rows, "component", 7, frames).collect()}
    assert got == {(5, y, x) for y in range(4) for x in range(4)} | {(6, 0, x) for x in range(6)}


def test_pairs_of_listings(spark):
    one = spark.createDataFrame([(1, "b/1"), (1, "a/1"), (1, "a/111"), (2, "x"), (None, "n"), (4, None)], "id long, path string")
    two = spark.createDataFrame([(1, "p"), (3, "q"), (None, "m"), (4, "r")], "id long, path string")
    got = sorted((tuple(r) for r in joins.paired(one, two, "id").collect()), key=repr)
    want = [(1, "a/1", "p", 3, 1, "ambiguous"), (2, "x", None, 1, 0, "source-only"), (3, None, "q", 0, 1, "preview-only"), (4, None, "r", 1, 1, "paired"), (None, "n", None, 1, 0, "source-only"), (None, None, "m", 0, 1, "preview-only")]
    assert got == sorted(want, key=repr)
    assert joins.paired(one.limit(0), two.limit(0), "id").count() == 0


def test_paths_and_plan_entries(spark):
    svg = '<svg><g><path id="a" d="M -1 0 C 1 1 2 2 9 3"/><path id="b" d=""/><path id="a" d="M 0 0 L 1 1"/><path d="M 0 0"/></g></svg>'
    docs = spark.createDataFrame([(1, svg, '{"edges": {"a": ["left"], "c": []}}', 8, 8), (2, "no xml <", "{}", 8, 8), (3, None, None, 8, 8)], "image_id long, svg string, plan string, width int, height int")
    got = validate.path_pairs(docs.where("image_id <> 2").withColumn("plan", F.try_parse_json("plan")), "edges").collect()
    rows = sorted((r.path_id, r.in_svg, r.in_plan, r.bleeds) for r in got)
    assert sorted(rows, key=repr) == sorted([("a", True, True, True), ("a", True, True, False), ("b", True, False, None), ("c", False, True, None)], key=repr)


def test_keys_on_every_level(spark):
    deep = '{"A": [1, {"b": {"c": [[{"d": null}]]}}]}'
    for i in range(15):
        deep = f'{{"k{i}": {deep}}}'
    rows = spark.createDataFrame([(1, deep, "x"), (2, "[]", "x"), (3, None, "x"), (4, "no json", "x"), (5, "7", "x")], "id long, doc string, v string")
    got = {(r.id, r.name) for r in validate.nested_keys(rows, "id", "doc").collect()}
    assert got == {(1, k) for k in [*"abcd", *(f"k{i}" for i in range(15))]}
    assert validate.nested_keys(rows.limit(0), "id", "doc").count() == 0


def test_micro_gate_of_tables_is_that_of_outlines(spark):
    rng = np.random.default_rng(3)
    rings = [np.stack([30 * np.cos(t), 30 * np.sin(t)], 1) + rng.normal(0, 0.6, (n, 2)) for n in (64, 11, 12, 9, 40) for t in [np.arange(n) * 2 * np.pi / n]]
    rows = [(k, i, float(x), float(y)) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    df = spark.createDataFrame(rows, "loop long, seq long, x double, y double").repartition(3)
    got = {(r.loop, r.seq): (r.x, r.y) for r in geometry.micro_gated(df, ["loop"]).collect()}
    moved = 0
    for k, ring in enumerate(rings):
        want = geometry.without_roughness(ring, 0.82)
        moved += np.abs(want - ring).max() > 0.05
        assert np.allclose([got[k, i] for i in range(len(ring))], want, atol=1e-9)
    assert moved >= 2 and geometry.micro_gated(df.limit(0), ["loop"]).count() == 0
