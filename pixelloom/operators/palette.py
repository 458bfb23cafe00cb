"""Palettes: candidate colours by median cut, roles by greedy diversity, nearest-role labels.

Candidates are at most a few dozen rows an image; everything that touches pixels is an aggregate or a projection.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.operators.aggregates import median_color
from pixelloom.operators.components import stored
from pixelloom.operators.joins import nearest_centre_of_image

#: Least share and chroma of the accent role; weight of rarity against frequency.
ACCENT_SHARE, ACCENT_CHROMA, DISTANCE_FLOOR = 0.004, 0.040, 0.35


def candidate_count(colors: int) -> int:
    return min(24, max(2 * colors, colors + 4))


def cut_boxes(colors: np.ndarray, counts: np.ndarray, boxes: int) -> np.ndarray:
    """The box of each distinct colour: the box with the widest channel is halved at its weighted median, until there are
    `boxes` of them or none has two colours. Of equally wide ones the first box and the first channel go."""
    box = np.zeros(len(colors), np.int64)
    for new in range(1, boxes):
        spans = [np.ptp(colors[box == k], axis=0) for k in range(new)]
        pick = max(range(new), key=lambda k: (spans[k].max(), -k))
        if spans[pick].max() == 0:
            break
        own = np.flatnonzero(box == pick)
        values = colors[own, int(spans[pick].argmax())]
        order = np.argsort(values, kind="stable")
        middle = values[order][np.searchsorted(np.cumsum(counts[own][order]), counts[own].sum() / 2)]
        middle = min(middle, values.max() - 1)
        box[own[values > middle]] = new
    return box


def median_cut(pixels: DataFrame, boxes: int) -> DataFrame:
    """pixels with `box`. Colours are counted first: a kernel gets the distinct colours of one image, not its pixels."""
    colors = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "g", "b"], ignore_index=True)
        return pdf[["image_id", "r", "g", "b"]].assign(box=cut_boxes(pdf[["r", "g", "b"]].to_numpy(), pdf["n"].to_numpy(), boxes))

    return pixels.join(colors.groupBy("image_id").applyInPandas(kernel, "image_id long, r int, g int, b int, box long").hint("merge"), ["image_id", "r", "g", "b"])


def candidates(boxed: DataFrame) -> DataFrame:
    """(image_id, candidate, r, g, b, population, share, L, a, bb, chroma) of the boxes."""
    out = median_color(boxed, ["image_id", "box"]).withColumnRenamed("box", "candidate")
    lab = color.oklab(F.col("r"), F.col("g"), F.col("b"))
    out = out.withColumn("share", F.col("population") / F.sum("population").over(Window.partitionBy("image_id")))
    return out.select("*", *(c.alias(n) for c, n in zip(lab, ("L", "a", "bb"), strict=True))).withColumn("chroma", F.sqrt(F.col("a") * F.col("a") + F.col("bb") * F.col("bb")))


def pick_roles(population: np.ndarray, share: np.ndarray, chroma: np.ndarray, lab: np.ndarray, roles: int) -> list[int]:
    """Places of the commonest candidate, the most chromatic one of some size, then whichever is farthest from those chosen,
    weighted by frequency; first ones of equal ones. Fewer candidates give fewer roles."""
    chosen = [int(population.argmax())]
    large = np.flatnonzero(share >= ACCENT_SHARE)
    accent = int(large[chroma[large].argmax()]) if len(large) else chosen[0]
    if accent not in chosen and chroma[accent] >= ACCENT_CHROMA:
        chosen.append(accent)
    weight = DISTANCE_FLOOR + (1 - DISTANCE_FLOOR) * np.sqrt(population / population.max())
    while len(chosen) < min(roles, len(population)):
        near = np.sqrt(((lab[:, None, :] - lab[chosen][None, :, :]) ** 2).sum(2)).min(1) * weight
        near[chosen] = -1
        chosen.append(int(near.argmax()))
    return chosen


def diverse_roles(found: DataFrame, roles: int) -> DataFrame:
    """(image_id, label, candidate, r, g, b, L, a, bb): the roles of each image, from its few candidates."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("candidate", ignore_index=True)
        at = pick_roles(*(pdf[c].to_numpy() for c in ("population", "share", "chroma")), pdf[["L", "a", "bb"]].to_numpy(), roles)
        return pdf.loc[at, ["image_id", "candidate", "r", "g", "b", "L", "a", "bb"]].assign(label=range(len(at)))

    return found.groupBy("image_id").applyInPandas(kernel, "image_id long, candidate long, r int, g int, b int, L double, a double, bb double, label int")


def labelled(pixels: DataFrame, roles: DataFrame) -> DataFrame:
    """pixels with the label of the nearest role in Oklab."""
    lab = color.oklab(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.select("*", *(c.alias(n) for c, n in zip(lab, ("L", "a", "bb"), strict=True)))
    return nearest_centre_of_image(rows, ["L", "a", "bb"], roles.select("image_id", "label", "L", "a", "bb"))


def quantised(pixels: DataFrame, colors: int = 6) -> tuple[DataFrame, DataFrame]:
    """(labelled pixels, roles) of images: median cut, diverse roles, nearest role."""
    roles = stored(diverse_roles(candidates(median_cut(pixels, candidate_count(colors))), colors))
    return labelled(pixels, roles), roles
