"""Appends open only files that may hold a key of the batch."""

from barloom.sources import manifest, sinks


def rows(spark, low, high, parts=2):
    return spark.range(low, high, 1, parts).selectExpr("concat('k', id) AS key", "id * 2 AS value", "cast(id % 2 AS int) AS side")


def test_appends(spark, tmp_path):
    path = str(tmp_path / "table")
    for low, high in ((0, 100), (50, 150), (1000, 1100), (0, 1100)):
        sinks.append_absent(spark, rows(spark, low, high), path, ["key"])
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("key").distinct().count() == 1100
    before = len(stored.inputFiles())
    sinks.append_absent(spark, rows(spark, 0, 1100), path, ["key"])
    assert spark.read.parquet(path).count() == 1100 and before <= len(spark.read.parquet(path).inputFiles())


def test_files_that_cannot_match_stay_closed(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(5):
        sinks.append_absent(spark, rows(spark, k * 1000, k * 1000 + 200, 1), path, ["key"])
    every = len(spark.read.parquet(path).inputFiles())
    near, described = sinks.files_to_compare(spark, rows(spark, 3000, 3050), path, ["key"])
    assert every == 5 and len(described) == 5 and len(near) == 1
    none, _ = sinks.files_to_compare(spark, rows(spark, 90_000, 90_050), path, ["key"])
    assert none == []
    both, _ = sinks.files_to_compare(spark, rows(spark, 1100, 2100), path, ["key"])
    assert len(both) == 2  # every file that holds one of the keys
    rows(spark, 70_000, 70_010, 1).write.mode("append").parquet(path)  # written by someone else, so not described
    near, _ = sinks.files_to_compare(spark, rows(spark, 3000, 3050), path, ["key"])
    assert len(near) == 2


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.append_absent(spark, rows(spark, 0, 50), path, ["key", "side"], ["side"])
    sinks.append_absent(spark, rows(spark, 0, 60), path, ["key", "side"], ["side"])
    assert spark.read.parquet(path).count() == 60
    described = spark.read.parquet(f"{path}-manifest")
    assert described.columns == manifest.FILES.fieldNames()
