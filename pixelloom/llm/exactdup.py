"""Exact deduplication as a stateful stream.

Records (digest, id, locator) land as files and run through Structured Streaming. The state, one entry for each digest in
RocksDB on the executors' disks with its log in the checkpoint folder, never expires; it keeps the digest, the stable
identifier of the row that stays, the locator of its content (file and id) and a count. The aggregation is partial before
the shuffle, so that a text with very many copies arrives as one record for each task.

A digest that was met again is only a hit. The full bytes of all rows under it are then compared with those of the row at
the state's locator; rows under a digest whose bytes differ are regrouped by text, so that a colliding digest cannot merge
different texts.

Texts are equal if their characters are; null counts as empty. The largest id stays; a null id is smaller than any other.
If rows repeat id and text, one of them is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

#: Ways in which the rows of one digest are dealt out for the comparison of bytes.
SALTS = 16
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stream_state(records: DataFrame, files_per_batch: int = 1000, state: str | None = None) -> DataFrame:
    """A table (digest, keep, group_size) after all records (digest, doc, file) have gone through the stream.

    keep is (doc, file) of the row that stays. state: a shared folder that keeps the stream's log and state, so that a later
    call with new records goes on from all earlier ones. Without one the stream ends here, and what it has written is
    deleted once the table stands.
    """
    spark = records.sparkSession
    folder = state.rstrip("/") if state else C.scratch_path(spark, "stream")
    landing, out, log = (f"{folder}/{x}" for x in ("records", "updates", "log"))
    records.write.mode("append").parquet(landing)
    arriving = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    counted = arriving.groupBy("digest").agg(F.max(F.struct("doc", "file")).alias("keep"), F.count("*").alias("group_size"))

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that runs again replaces its own output

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = counted.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.exception() is not None:
        raise query.exception()
    schema = "digest binary, keep struct<doc: long, file: string>, group_size long, batch int"
    updates = spark.read.schema(schema).parquet(out) if C.exists(spark, out) else spark.createDataFrame([], schema)
    last = updates.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("v"))
    table = C.written(last.select("digest", "v.keep", "v.group_size"), "digests")
    if state is None:
        C.dropped(spark, folder)
    return table


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 1000) -> DataFrame:
    """Per row: id, keep_id, group_size, kept and text_sha256. digest: from the text column to a binary column."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.input_file_name().alias("file"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    state = stream_state(rows.select("digest", "doc", "file"), files_per_batch)

    # of each hit, the bytes of every row are held against those at the locator that the state holds
    hits = state.where("group_size > 1").select("digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "file"), F.lit(SALTS)).cast("int"))
    located = F.when(F.struct("doc", "file").eqNullSafe(F.col("keep")), F.col("text"))
    compared = salted.join(hits, ["digest", "salt"]).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.max(located).alias("at"))
    differ = C.written(compared.where("low <> at or high <> at or at is null").select("digest"), "collisions")

    keys = ["digest", "doc"]
    named = rows.groupBy(*keys, F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("times"))
    columns = ["doc", "keep_id", "group_size", "text_sha256", "times"]
    joined = named.join(state, "digest").select("doc", F.col("keep.doc").alias("keep_id"), "group_size", "text_sha256", "times", "digest")
    # rows under a digest of several texts are grouped by the text itself
    apart = rows.join(differ, "digest", "left_semi")
    groups = apart.groupBy("text").agg(F.max("doc").alias("keep_id"), F.count("*").alias("group_size"))
    regrouped = apart.groupBy("text", "doc").agg(F.count("*").alias("times")).join(groups, "text").withColumn("text_sha256", F.sha2("text", 256))
    joined = joined.join(differ, "digest", "left_anti").select(*columns).unionByName(regrouped.select(*columns))
    out = joined.select("doc", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    kept = (F.col("copy") == 1) & F.col("doc").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("doc").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
