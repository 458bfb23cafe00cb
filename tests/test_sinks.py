import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelloom.sources import runs, sinks

SCHEMA = "id string, `group` string, validation string, duplicate_of string"


def rows(spark, n=20):
    return spark.createDataFrame([(f"{i:03d}", "ab"[i % 2], "PASS" if i % 5 else "FAIL", f"{i - 1:03d}" if i % 4 == 3 else None) for i in range(n)], SCHEMA).repartitionByRange(3, "id").sortWithinPartitions("id")


def write(df, path, **more):
    options = {"path": path, "title": "Review", "passed": "validation", "groups": "group", "unique": "duplicate_of"} | more
    df.write.format("manifest").options(**options).mode("append").save()


def test_one_csv_and_one_readme(spark, tmp_path):
    sinks.register(spark)
    path = str(tmp_path / "out")
    write(rows(spark), path, template="shortlist.csv", template_columns="id,decision")
    assert sorted(os.listdir(path)) == ["README.md", "manifest.csv", "shortlist.csv"] and os.listdir(tmp_path) == ["out"]
    lines = open(f"{path}/manifest.csv").read().splitlines()
    assert lines[0] == "id,group,validation,duplicate_of" and [x[:3] for x in lines[1:]] == [f"{i:03d}" for i in range(20)] and lines[1] == "000,a,FAIL,"
    readme = open(f"{path}/README.md").read()
    assert all(x in readme for x in ("# Review", "Rows: 20", "Passed: 16 of 20", "Unique: 15", "- a: 10", "- b: 10"))
    assert open(f"{path}/shortlist.csv").read() == "id,decision\n"
    with pytest.raises(PySparkException, match="exists"):
        write(rows(spark), path)
    assert open(f"{path}/README.md").read() == readme


def test_odd_values_and_an_empty_table(spark, tmp_path):
    sinks.register(spark)
    df = spark.createDataFrame([('a"b', "x,y", "l\nm", None)], SCHEMA)
    write(df, str(tmp_path / "odd"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "odd/manifest.csv")).collect()[0][:3] == ('a"b', "x,y", "l\nm")
    write(df.limit(0), f"file://{tmp_path}/none")
    assert open(tmp_path / "none/manifest.csv").read() == "id,group,validation,duplicate_of\n" and "Rows: 0" in open(tmp_path / "none/README.md").read()


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    """Other tasks have written their parts by then; neither file appears, and the staging folder goes."""
    sinks.register(spark)
    bad = rows(spark).withColumn("id", F.when(F.col("id") == "019", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        write(bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_parts_of_repeated_tasks_are_not_taken(tmp_path):
    """Only the parts that commit messages name are joined, in the order of partitions."""
    from pyspark.sql.types import StructType

    w = sinks.ManifestWriter({"path": str(tmp_path / "out")}, StructType.fromDDL("id string"))
    one, _lost, two = w.write(iter([("b",)])), w.write(iter([("lost",)])), w.write(iter([("a",)]))
    two.partition, one.partition = 0, 1
    w.commit([one, None, two])
    assert open(tmp_path / "out/manifest.csv").read() == "id\na\nb\n" and os.listdir(tmp_path) == ["out"]


def test_reruns_replace_and_order_does_not_matter(spark, tmp_path):
    first = spark.createDataFrame([(i, "done", "FAIL" if i == 3 else "PASS", i) for i in range(5)], "image_id long, status string, validation string, shape_count int")
    again = spark.createDataFrame([(3, "done", "PASS", 9, "x"), (7, "failed", None, None, "x")], "image_id long, status string, validation string, shape_count int, attempt string")
    seen = []
    for k, order in enumerate(([0, 1], [1, 0], [0, 1, 0, 1, 1])):
        folder = str(tmp_path / f"log{k}")
        for i in order:
            runs.append((first, again)[i], folder, "night/run", i + 1)
        runs.append(first, folder, "other", 1)
        log = runs.log(spark, folder)
        seen.append(sorted((tuple(r) for r in runs.current(log).collect()), key=repr))
        assert {r.run: (r.images, r.passed, r.failed, r.shapes) for r in runs.summary(log).collect()} == {"night/run": (6, 5, 1, 16), "other": (5, 4, 0, 10)}
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 11


def test_a_batch_appends_a_row_for_each_listed_image(spark, tmp_path):
    pixels = spark.createDataFrame([(1, y, x, 200 if (x - 12) ** 2 + (y - 9) ** 2 < 30 else 60, 90 + 4 * y, 40) for y in range(20) for x in range(24)], "image_id long, y int, x int, r int, g int, b int")
    listed = spark.createDataFrame([(1,), (2,)], "image_id long")
    got = runs.run_batch(pixels, listed, str(tmp_path / "log"), "r", 1, runs.Options(palette_size=4, max_shapes=3), "set")
    assert got["documents"] == 1 and got["characters"] > 100
    rows = {r.image_id: r for r in runs.current(runs.log(spark, str(tmp_path / "log"))).collect()}
    assert rows[1].status == "done" and rows[1].archetype == "general" and rows[1].shape_count > 0 and rows[1].elapsed_seconds > 0
    assert (rows[2].status, rows[2].validation, rows[2].elapsed_seconds) == ("failed", None, 0.0)
