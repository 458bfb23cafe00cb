"""Connected pixels: components, floods and holes, on run-length nodes.

A row of neighbouring pixels is one node, an edge joins runs that overlap in adjacent rows, and labels travel by rounds of
minimum exchange and path halving. Each round is a table in the folder that the cluster shares, so a lost executor costs
one round at most, and the plan stays short.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.masks import PIXEL, complement

ROUNDS = 60
#: Bits of x in a linear pixel number.
WIDE = 1 << 20
#: Rows of an image that one task joins.
BAND = 256


def shared_folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark, *tasks: Callable) -> list:
    """Results of tasks that do not need each other, in their order. A task takes nothing and stores tables on its way; the
    jobs of all tasks are submitted side by side, so that small ones do not wait for each other's planning."""
    shared_folder(spark)  # found once, before the tasks look for it
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


def without_rows(df: DataFrame) -> bool:
    return not df.limit(1).count()


def runs(mask: DataFrame, label: str | None = None) -> DataFrame:
    """(image_id, y, x0, x1, node, label): rows of neighbouring pixels with one label; node is the first pixel's number."""
    kind = F.col(label) if label else F.lit(0)
    rows = mask.select("image_id", "y", "x", kind.alias("label"))
    w = Window.partitionBy("image_id", "y").orderBy("x")
    start = F.coalesce((F.lag("x").over(w) != F.col("x") - 1) | (F.lag("label").over(w) != F.col("label")), F.lit(True))
    rows = rows.withColumn("island", F.sum(start.cast("int")).over(w))
    out = rows.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("label").alias("label"))
    return out.select("image_id", "y", "x0", "x1", "label", (F.col("y").cast("long") * WIDE + F.col("x0")).alias("node"))


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of a band with local, the first node of their component within it: hooks to smaller roots and pointer jumps."""
    pdf = pdf.sort_values("node", ignore_index=True)
    y, x0, x1, label = (pdf[c].to_numpy() for c in ("y", "x0", "x1", "label"))
    below = (y.astype(np.int64) + 1) * WIDE
    low, high = np.searchsorted(y.astype(np.int64) * WIDE + x1, below + x0), np.searchsorted(pdf["node"].to_numpy(), below + x1, side="right")
    count = np.maximum(high - low, 0)
    one = np.repeat(np.arange(len(pdf)), count)
    other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    same = label[one] == label[other]
    one, other = one[same], other[same]
    root = np.arange(len(pdf))
    while (root[one] != root[other]).any():
        p, q = root[one], root[other]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return pdf.assign(local=pdf["node"].to_numpy()[root])


def run_components(nodes: DataFrame, rounds: int = ROUNDS, band: int = BAND) -> DataFrame:
    """nodes with root, the smallest node of their component.

    Bands of rows are joined within a task, which holds the runs of one band; the components of bands that meet at a border
    are then joined by rounds over their numbers alone. Images of one band need no round.
    """
    kind = nodes.schema["label"].dataType.simpleString()
    rows = nodes.select("image_id", "y", "x0", "x1", "label", "node")
    local = rows.groupBy("image_id", F.floor(F.col("y") / band)).applyInPandas(_joined, f"image_id long, y int, x0 int, x1 int, label {kind}, node long, local long")
    nodes = stored(local)
    if without_rows(nodes.where(F.pmod("y", F.lit(band)) == band - 1)):  # nothing lies at a border
        return nodes.withColumnRenamed("local", "root")
    upper, lower = (nodes.where(F.pmod("y", F.lit(band)) == at) for at in (band - 1, 0))
    a, b = upper.alias("a"), lower.select("image_id", F.col("y").alias("y2"), F.col("x0").alias("o0"), F.col("x1").alias("o1"), F.col("label").alias("label2"), F.col("local").alias("other")).alias("b")
    touch = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") + 1 == F.col("b.y2")) & (F.col("a.label") == F.col("b.label2")) & (F.col("a.x0") <= F.col("b.o1")) & (F.col("b.o0") <= F.col("a.x1"))
    down = a.join(b, touch).select("a.image_id", F.col("a.local").alias("node"), F.col("b.other").alias("other"))
    edges = stored(down.unionByName(down.select("image_id", F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    if without_rows(edges):
        return nodes.withColumnRenamed("local", "root")
    label = edges.select("image_id", "node", F.col("node").alias("root")).distinct()
    for _ in range(rounds):
        near = edges.join(label.select("image_id", F.col("node").alias("other"), "root"), ["image_id", "other"]).groupBy("image_id", "node").agg(F.min("root").alias("least"))
        step = label.join(near, ["image_id", "node"]).select("image_id", "node", "root", F.least("root", "least").alias("least"))
        jump = step.join(label.select("image_id", F.col("node").alias("least"), F.col("root").alias("further")), ["image_id", "least"])
        label = stored(jump.select("image_id", "node", F.col("root").alias("before"), F.least("least", "further").alias("root")))
        if without_rows(label.where("before <> root")):
            found = label.select("image_id", F.col("node").alias("local"), "root")
            return nodes.join(found, ["image_id", "local"], "left").withColumn("root", F.coalesce("root", "local")).drop("local")
        label = label.select("image_id", "node", "root")
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def components(mask: DataFrame, label: str | None = None, band: int = BAND) -> DataFrame:
    """(image_id, y, x, component) of 4-connected pixels, of one label if one is named; component is y * WIDE + x of its
    first pixel in reading order."""
    found = run_components(runs(mask, label), band=band)
    cols = [*PIXEL, F.col("root").alias("component"), *([F.col("label").alias(label)] if label else [])]
    return found.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "root", "label").select(cols)


def measures(parts: DataFrame, *keys: str) -> DataFrame:
    """Area, box and centre of each component."""
    return parts.groupBy("image_id", "component", *keys).agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def largest(mask: DataFrame, frames: DataFrame, share: float, limit: int) -> DataFrame:
    """Pixels of the largest components of an image, at most limit, each of at least a share of the frame."""
    parts = stored(components(mask))
    size = parts.groupBy("image_id", "component").agg(F.count("*").alias("area")).join(frames, "image_id").where(F.col("area") >= F.col("width") * F.col("height") * share)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "component"))
    return parts.join(size.withColumn("rank", rank).where(F.col("rank") <= limit).select("image_id", "component", "rank", "area"), ["image_id", "component"])


def touching(parts: DataFrame, where) -> DataFrame:
    """Pixels of the components that have a pixel where a condition holds."""
    return parts.join(parts.where(where).select("image_id", "component").distinct().hint("merge"), ["image_id", "component"], "left_semi")


def bottom_connected(mask: DataFrame, frames: DataFrame, band: int | Column = 1) -> DataFrame:
    """Pixels connected to the lowest rows, which count as part of the mask."""
    from pixelloom.operators.masks import frame_grid, union

    floor = frame_grid(frames).join(frames, "image_id").where(F.col("y") >= F.col("height") - band).select(PIXEL)
    parts = stored(components(union(mask, floor)).join(frames.select("image_id", "height"), "image_id"))
    return touching(parts, F.col("y") == F.col("height") - 1).select(PIXEL)


def holes(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """(image_id, y, x, component) of the parts of the complement that don't reach the frame."""
    frames = frames.select("image_id", "width", "height")
    parts = stored(components(complement(mask.select(PIXEL), frames)).join(frames, "image_id"))
    edge = parts.where("x = 0 or y = 0 or x = width - 1 or y = height - 1").select("image_id", "component").distinct()
    return parts.join(edge.hint("merge"), ["image_id", "component"], "left_anti").select(*PIXEL, "component")


def filled(mask: DataFrame, frames: DataFrame, most: int | Column | None = None) -> DataFrame:
    """A mask with its holes filled, those of at most `most` pixels if given: a number, or a column of frames."""
    inner = holes(mask, frames)
    if most is not None:
        inner = stored(inner)
        small = inner.groupBy("image_id", "component").agg(F.count("*").alias("area")).join(frames, "image_id").where(F.col("area") <= most)
        inner = inner.join(small.hint("merge"), ["image_id", "component"], "left_semi")
    return mask.select(PIXEL).unionByName(inner.select(PIXEL))


def below_sky(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """Everything that the top row does not reach through the complement of the mask."""
    from pixelloom.operators.masks import difference, frame_grid

    parts = stored(components(complement(mask, frames)))
    return difference(frame_grid(frames), touching(parts, F.col("y") == 0))


def grown(seed: DataFrame, domain: DataFrame, frames: DataFrame, rounds: int = 16) -> DataFrame:
    """A seed grown by one pixel a round inside a domain, until nothing is added or the rounds end."""
    from pixelloom.operators.masks import difference, intersection
    from pixelloom.operators.stencils import dilated

    done = front = stored(seed.select(PIXEL))
    for _ in range(rounds):
        front = stored(difference(intersection(dilated(front, 3, frames), domain), done))
        if without_rows(front):
            break
        done = done.unionByName(front)
    return done


def coherence(parts: DataFrame, label: str) -> DataFrame:
    """(image_id, coherence): the largest components of all labels, as a share of the pixels."""
    size = parts.groupBy("image_id", label, "component").agg(F.count("*").alias("area"))
    best = size.groupBy("image_id", label).agg(F.max("area").alias("largest"), F.sum("area").alias("all"))
    return best.groupBy("image_id").agg((F.sum("largest") / F.sum("all")).alias("coherence"))
