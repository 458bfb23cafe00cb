import datetime as dt

from pyspark.sql import functions as F

from pixelloom.streaming import arrivals


def test_listing_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, log = str(tmp_path / "out"), str(tmp_path / "log")
    for names in (["a", "b"], ["c"], []):
        for n in names:
            (tmp_path / "in" / f"{n}.bin").write_text(n)
        arrivals.append_listing(spark, str(tmp_path / "in"), table, log, 1).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted(r.path[-5] for r in rows) == ["a", "b", "c"] and len({r.sha256 for r in rows}) == 3


def test_counts_close_their_windows(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1, 5), 10, 10, 10), (1, at(1, 50), 30, 30, 30)], [(1, at(3, 0), 0, 0, 0)], [(1, at(1, 10), 99, 99, 99), (1, at(5, 0), 0, 0, 0)]]
    schema = "image_id long, arrived timestamp, r int, g int, b int"
    src, table = str(tmp_path / "src"), str(tmp_path / "counts")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        stream = arrivals.color_counts(spark.readStream.schema(schema).parquet(src)).select(F.col("window.start").alias("start"), "image_id", "pixels", "luminance")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(table).awaitTermination()
    first = spark.read.parquet(table).where(F.hour("start") == 1).collect()
    assert [(r.pixels, round(r.luminance, 6)) for r in first] == [(2, 20.0)]
