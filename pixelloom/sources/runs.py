"""Batch runs: a row for each image of each run, which a rerun replaces.

The log is a table partitioned by run and attempt. An attempt is written as a whole and again as a whole, so that repeating it,
after a failure or by mistake, changes nothing; attempts may arrive in any order. What counts for an image is its row of the
greatest attempt, which `current` takes with partial aggregates: images that a later attempt did not hold keep their row.
"""

from __future__ import annotations

import time
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import validate
from pixelloom.operators.components import stored
from pixelloom.plans.abstraction import abstraction
from pixelloom.plans.options import Options

ROW = "image_id bigint, dataset string, status string, archetype string, shape_count int, validation string, failed_checks string, elapsed_seconds double"
LOG = ROW + ", run string, attempt bigint"


def append(rows: DataFrame, folder: str, run: str, attempt: int) -> None:
    """Write one attempt of a run; columns that rows lack are null, others are left out."""
    have = set(rows.columns)
    cols = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ROW.split(", "))]
    rows.select(cols).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={quote(run, safe='')}/attempt={int(attempt)}")


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).option("basePath", folder).parquet(folder)


def current(rows: DataFrame) -> DataFrame:
    """LOG rows that count: each image's of the greatest attempt of a run. Of several rows that one attempt has for an image
    the greatest counts, so that the result does not depend on their order."""
    rest = [c for c in rows.columns if c not in ("run", "image_id", "attempt")]
    best = rows.groupBy("run", "image_id").agg(F.max(F.struct("attempt", *rest)).alias("b"))
    return best.select("run", "image_id", "b.*")


def summary(rows: DataFrame) -> DataFrame:
    """(run, images, passed, failed, shapes, seconds) of the rows that count."""
    return current(rows).groupBy("run").agg(
        F.count("*").alias("images"), F.count_if(F.col("validation") == "PASS").alias("passed"), F.count_if(F.col("status") != "done").alias("failed"), F.sum("shape_count").alias("shapes"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds")
    )


def run_batch(pixels: DataFrame, listed: DataFrame, folder: str, run: str, attempt: int, options: Options = Options(), dataset: str = "") -> dict:  # noqa: B008
    """Compose and validate the images of pixels and append a row for each listed image_id; those without a document have failed.
    Returns what was observed while the documents were written. The time of a batch is shared out by pixels."""
    began, seen = time.monotonic(), Observation()
    pixels = stored(pixels)
    docs = abstraction(pixels, options).withColumn("plan", F.try_parse_json("plan"))
    docs = stored(docs.observe(seen, F.count("*").alias("documents"), F.sum(F.length("svg")).alias("characters")).withColumn("plan", F.to_json("plan")))
    measured = validate.measured(docs.withColumn("plan", F.try_parse_json("plan")))
    reports = validate.reports(validate.validated(measured, "image_id", validate.structural_rules() | validate.plan_rules()), "image_id")
    facts = docs.select("image_id", F.get_json_object("plan", "$.archetype").alias("archetype"), F.get_json_object("plan", "$.shape_count").cast("int").alias("shape_count"))
    rows = stored(facts.join(reports, "image_id").select("*", F.col("result").alias("validation")).drop("result"))
    seconds = time.monotonic() - began
    area = pixels.groupBy("image_id").agg(F.count("*").alias("area"))
    total = area.agg(F.sum("area")).first()[0] or 1
    out = listed.select("image_id").distinct().join(rows, "image_id", "left").join(area, "image_id", "left")
    status = F.when(F.col("validation").isNull(), "failed").otherwise("done")
    append(out.select("*", F.lit(dataset).alias("dataset"), status.alias("status"), F.round(F.coalesce("area", F.lit(0)) / total * seconds, 6).alias("elapsed_seconds")), folder, run, attempt)
    return seen.get | {"seconds": seconds}
