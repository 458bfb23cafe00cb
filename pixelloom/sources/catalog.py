"""Listings, manifests and checksums of files and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.scalars import padded_id
from pixelloom.operators.components import stored
from pixelloom.sources.raster import numbered

RUN_MANIFEST = (
    "id string, dataset string, source string, svg string, analysis string, preview string, comparison string, validation string, failed_checks string, archetype string, shape_count int, elapsed_seconds double"
)
REVIEW_MANIFEST = "id string, `group` string, modified_at string, source_path string, collected_file string, width int, height int, bytes bigint, sha256 string, duplicate_of string"


def read_manifest(spark: SparkSession, path: str, schema: str = RUN_MANIFEST) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", "true").csv(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """Passes and time by dataset."""
    return runs.groupBy("dataset").agg(F.count("*").alias("runs"), F.count_if(F.col("validation") == "PASS").alias("passed"), F.sum("shape_count").alias("shapes"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds"))


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(path, plan): each file one JSON object."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("plan"))


def read_svgs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("svg"))


def ini_value(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", rf"^\s*{key}\s*=\s*(\S.*?)\s*$", 1).alias(key)).where(F.col(key) != "")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", "length")


def review(files: DataFrame) -> DataFrame:
    """files (path, group, modified, content) numbered by (group, modified, path), with digests and first copies. The contents
    are digested where they are read and travel no further."""
    rows = files.select("path", "group", "modified", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = stored(numbered(rows, "group", "modified", "path"))
    first = rows.groupBy("sha256").agg(F.min("id").alias("_first"))
    return rows.join(first, "sha256").select(padded_id(F.col("id")).alias("id"), "group", "path", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"), "bytes", "sha256", padded_id(F.when(F.col("_first") != F.col("id"), F.col("_first"))).alias("duplicate_of"))
