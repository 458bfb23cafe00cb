import numpy as np
import pytest

from pixelloom.operators import detect
from pixelloom.sources import raster


def pixels_of(spark, *images):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")


def road(size=100, top=56, breaks=(), ink=(255, 200, 40), x=50, wide=2, fragment=None):
    """A grey image with a bright line from the bottom; rows in breaks are left out, rows in fragment are drawn weaker."""
    a = np.full((size, size, 3), 90)
    for y in range(top, size):
        if y not in breaks:
            a[y, x : x + wide] = ink
    for y in fragment or ():
        a[y, x : x + wide] = (150, 130, 70)
    return a


def test_lines_are_extended_by_aligned_fragments(spark):
    images = [
        road(),
        road(top=65, fragment=range(55, 60)),  # a run of five rows above the line
        road(top=65, fragment=[56, 57]),  # two rows are no run
        road(x=20),  # does not start near the middle
        road(top=90),  # too short
        road(wide=9),  # too wide
        road(ink=(140, 140, 140)),  # no colour
    ]
    px = pixels_of(spark, *images)
    frames = raster.frames(px)
    lines = detect.accent_line(px, frames)
    got = {r.image_id: r for r in lines.collect()}
    assert set(got) == {0, 1, 2}
    assert [r.y1 for _, r in sorted(got.items())] == [99] * 3 and all(abs(r.slope) < 0.02 and 49 <= r.intercept <= 52 for r in got.values())
    assert got[0].y0 in (55, 56) and 54 <= got[1].y0 <= 56 and got[2].y0 in (64, 65)
    drawn = {}
    for r in detect.ribbon(lines, frames).collect():
        drawn.setdefault((r.image_id, r.y), []).append(r.x)
    for k, line in got.items():
        for y in range(line.y0, 100):
            t = (y - line.y0) / max(1, 99 - line.y0)
            mid, half = line.slope * y + line.intercept, 0.55 + (line.half - 0.55) * t**1.25
            assert sorted(drawn[k, y]) == list(range(int(np.floor(mid - half)), int(np.ceil(mid + half)) + 1))
        assert line.half == pytest.approx(max(1.3, 0.32 * 4), abs=0.35)


def ground(size=100, reach=(0, 70), rows=(55, 90), focal=(42, 53), sky=120, light=190, right=None):
    """A light mass over a grey image; `right` is the grey of its right part, another reference for its rows."""
    a = np.full((size, size, 3), sky)
    if right is not None:
        a[:, 75:] = right
    a[rows[0] : rows[1], reach[0] : reach[1]] = light
    a[focal[0] : focal[1], 45:51] = (220, 60, 40)
    return a


def test_support_stands_out_against_one_side_or_the_other(spark):
    images = [
        ground(),  # reaches the left side: only the right one tells it apart
        ground(reach=(30, 100)),  # the mirror of it
        ground(reach=(12, 80)),  # reaches no side
        ground(rows=(85, 98)),  # out of reach of the focal mask
        ground(reach=(0, 20)),  # too narrow
        ground(right=190),  # as light as the right side, and itself the left one
    ]
    px = pixels_of(spark, *images)
    frames = raster.frames(px)
    focal = spark.createDataFrame([(k, y, x) for k in range(len(images)) for y in range(42, 53) for x in range(45, 51)], "image_id long, y int, x int")
    got = {}
    for r in detect.luminous_support(px, frames, focal).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
    assert set(got) == {0, 1}
    for k, (x0, x1) in ((0, (0, 70)), (1, (30, 100))):
        want = {(y, x) for y in range(56, 89) for x in range(x0 + (x0 > 0), x1 - (x1 < 100))}
        wide = {(y, x) for y in range(51, 94) for x in range(x0 - 4, x1 + 4)}  # blur and closing widen it a little
        assert want <= got[k] <= wide


def test_no_images_and_no_focal_mask(spark):
    px = pixels_of(spark, ground())
    frames = raster.frames(px)
    none = px.limit(0)
    assert detect.luminous_support(px, frames, none.select("image_id", "y", "x")).count() == 0
    assert detect.accent_line(none, frames.limit(0)).count() == 0


def scene(labels=None, height=100, **marks):
    """A calm image with patches: name=(y0, y1, x0, x1, colour). Also the labels of its pixels."""
    a = np.full((height, 100, 3), (120, 120, 124))
    lab = np.zeros((height, 100), int)
    for y0, y1, x0, x1, ink in marks.values():
        a[y0:y1, x0:x1] = ink
    for y0, y1, x0, x1, k in labels or ():
        lab[y0:y1, x0:x1] = k
    return a, lab


def with_labels(spark, *scenes):
    rows = [(k, y, x, *map(int, a[y, x]), int(lab[y, x])) for k, (a, lab) in enumerate(scenes) for y in range(len(a)) for x in range(100)]
    return detect.with_oklab(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, label int"))


def test_compact_islands_keep_off_edges_and_protected_labels(spark):
    mark = (240, 230, 60)
    scenes = [
        scene(m=(40, 50, 44, 54, mark)),
        scene(m=(0, 10, 44, 54, mark)),  # at the frame's edge
        scene(m=(40, 50, 44, 54, mark), labels=[(0, 100, 0, 49, 1)]),  # two labels around it
        scene(m=(40, 50, 44, 54, mark), labels=[(40, 50, 44, 54, 7)]),  # protected by label 7
        scene(m=(40, 50, 44, 54, (128, 128, 132))),  # no contrast
    ]
    px = with_labels(spark, *scenes)
    found, mask = detect._compact(px, raster.frames(px), [7])
    assert {r.image_id for r in found.collect()} == {0}
    got = {(r.y, r.x) for r in mask.where("image_id = 0").collect()}
    core = {(y, x) for y in range(41, 49) for x in range(45, 53)}
    assert core <= got <= {(y, x) for y in range(34, 57) for x in range(38, 61)}


def test_rare_hues_take_in_caps_above_them(spark):
    rust, half = (152, 105, 102), [(0, 200, 0, 50, 1)]  # two labels meet in the patch
    patch = (100, 120, 40, 59, rust)
    scenes = [
        scene(half, 200, m=patch),
        scene(half, 200, m=patch, c=(86, 92, 46, 53, rust)),  # eight rows above
        scene(half, 200, m=patch, c=(60, 66, 46, 53, rust)),  # too far above
        scene(half, 200, m=patch, c=(86, 92, 70, 77, rust)),  # beside it
        scene(None, 200, m=patch),  # one label represents it
        scene(half, 200, m=(100, 120, 40, 59, (230, 60, 40))),  # no calm image
    ]
    px = with_labels(spark, *scenes)
    found, mask = detect._rare(px, raster.frames(px))
    got = {r.image_id: len(r.satellites) for r in found.collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
    drawn = {}
    for r in mask.collect():
        drawn.setdefault(r.image_id, set()).add((r.y, r.x))
    assert all({(y, x) for y in range(102, 118) for x in range(42, 57)} <= drawn[k] for k in got)
    assert {(y, 49) for y in range(88, 118)} <= drawn[1]  # the cap, and the bridge to it
    assert all(min(y for y, _ in drawn[k]) >= 95 for k in (0, 2, 3))


def mirrored(kind):
    """A wide image whose lower half mirrors the upper one; kind: what the lower half does with hue."""
    rng = np.random.default_rng(5)
    top = np.repeat(np.repeat(rng.integers(60, 200, (5, 14, 3)), 8, axis=0), 8, axis=1)
    low = top[::-1].copy()
    if kind == "grey":
        low[...] = low.mean(axis=2, keepdims=True)
    return np.concatenate([top, low])


def test_reflection_pools_both_channels_of_hue(spark):
    px = pixels_of(spark, mirrored("same"), mirrored("grey"))
    got = {r.image_id: r for r in detect.reflection(px, raster.frames(px)).collect()}
    assert got[0].axis == 40 and got[0].chroma > 0.99 and got[0].light > 0.99 and got[0].reflective
    assert abs(got[1].chroma) < 0.5 and not got[1].reflective


@pytest.mark.parametrize("kept", ["vec_id < 80", "vec_id < 65", "vec_id < 70 or vec_id in (130, 131, 133)"])
def test_mirror_axes_of_narrow_and_sparse_images_are_those_of_the_sql(spark, tmp_path, kept):
    import duckdb

    from pixelloom.plans import findings
    from tests.oracle import compare

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE {kept}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    why = compare(spark, con, "mirror_axes", findings.queries()["mirror_axes"], findings.oracle_sql()["mirror_axes"], str(tmp_path))
    assert why is None, why


def test_columns_of_clashing_names_are_not_read(spark):
    from pyspark.sql import functions as F

    from pixelloom.operators import components as K

    px = pixels_of(spark, mirrored("same"))
    more = px.select("*", *(F.lit("clash").alias(c) for c in ("w", "h", "width", "height", "component", "v", "t", "k")))
    frames = raster.frames(px)
    wider = frames.select("*", F.lit("clash").alias("component"), F.lit("clash").alias("y"))
    assert raster.resized(more, 24).count() == raster.resized(px, 24).count() > 0
    assert detect.night_gate(more).first() == detect.night_gate(px).first()
    assert detect.reflection(more, frames).first() == detect.reflection(px, frames).first()
    ring = spark.createDataFrame([(0, y, x, "clash") for y in range(2, 7) for x in range(2, 7) if (y, x) != (4, 4)], "image_id long, y int, x int, component string")
    assert [(r.y, r.x) for r in K.holes(ring, wider).collect()] == [(4, 4)]
