"""A training corpus from `documents`: language ID, exact dedup, near dedup, decontamination, packing.

Each stage is written as Parquet and read again by the next. All stages but the last keep the columns of documents. Rows
that share a doc_id stand or fall together in near dedup and decontamination; rows that also share the text become one in
exact dedup. An empty table passes through empty; extra columns of any name pass through the stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import _common, decontam, exactdup, langid, neardup, packing, queries

#: Score below which a language is not accepted; four equally likely languages have 0.25.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, least=LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exactdup.exact_duplicates(docs).where("kept")
    own_id, own_sha = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "sha"))  # names that no column of docs has
    keyed = docs.withColumn(own_id, _text_id("doc_id")).withColumn(own_sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = kept.select(_text_id("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    # rows that repeat id and text meet in the join's own partitions, where one of them stays
    return keyed.join(kept.hint("merge"), [own_id, own_sha], "left_semi").dropDuplicates([own_id, own_sha]).drop(own_id, own_sha)


def _text_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is among ids (left_semi) or not (left_anti); a null id equals a null id."""
    return docs.alias("_docs").join(ids.select("doc_id").alias("_ids").hint("merge"), F.col("_docs.doc_id").eqNullSafe(F.col("_ids.doc_id")), how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _of_ids(docs, neardup.near_duplicates(docs, shingle=5, percent=80).where("kept"), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _of_ids(docs, decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Training, sketches and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
