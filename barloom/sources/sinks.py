"""Append-only sinks over Parquet tables, idempotent by key or content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ingest import classify, dataset_hash, merge_incremental
from barloom.schema import IDENTITY, VALUES
from barloom.sources import manifest
from barloom.staging import hold


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows when it does not exist yet."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _opened(spark: SparkSession, path: str, schema: T.StructType, files: Sequence[str]) -> DataFrame:
    """Some files of the table at ``path``, with its partition columns."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)


def files_to_compare(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> tuple[list[str], set[str]]:
    """Files of the table that may hold a key of ``rows``, and the files that the manifest describes.

    A file that the manifest does not describe is always among the first.
    """
    present = read_or_empty(spark, path, rows.schema).inputFiles()
    known = read_or_empty(spark, f"{path}-manifest", manifest.FILES)
    described = {r["file"] for r in known.select("file").distinct().collect()}
    passed = set(manifest.matching(known, rows, keys)) if described else set()
    return [f for f in present if f not in described or f in passed], described


def _describe_new(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], described: set[str]) -> None:
    """Add the table's files that the manifest lacks."""
    new = [f for f in read_or_empty(spark, path, schema).inputFiles() if f not in described]
    if new:
        manifest.describe(_opened(spark, path, schema, new), keys).write.mode("append").parquet(f"{path}-manifest")


def append_absent(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str],
                  partition_by: Sequence[str] = ()) -> None:
    """Append the rows whose key is not in the table; of equal keys in the batch one is written.

    The files of each append are described in a manifest beside the table (``<path>-manifest``), and only
    files that may hold a key of the batch are opened.
    """
    keys = list(keys)
    batch = hold(rows.dropDuplicates(keys))
    near, described = files_to_compare(spark, batch, path, keys)
    fresh = batch.join(_opened(spark, path, rows.schema, near).select(*keys), keys, "left_anti")
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)
    _describe_new(spark, path, rows.schema, keys, described)


def import_bars(spark: SparkSession, bars: DataFrame, path: str, step_seconds: int) -> dict[str, object]:
    """Insert-if-absent import: the same content again is a no-op that reports only duplicates.

    ``path`` holds two tables: ``bars`` and ``datasets`` (content hash and row count).
    """
    known_schema = T.StructType([
        T.StructField("dataset_hash", T.StringType()), T.StructField("rows", T.LongType()),
    ])
    digest = dataset_hash(bars, step_seconds).first()["dataset_hash"]
    total = bars.count()
    datasets = read_or_empty(spark, f"{path}/datasets", known_schema)
    if not datasets.filter(F.col("dataset_hash") == digest).isEmpty():
        return {"dataset_id": digest, "inserted": 0, "duplicates": total}
    columns = [*IDENTITY, *VALUES]
    schema, keys = bars.select(*columns).schema, list(IDENTITY)
    near, described = files_to_compare(spark, bars, f"{path}/bars", keys)
    stored = _opened(spark, f"{path}/bars", schema, near)
    inserted = classify(bars, stored).agg(F.coalesce(F.sum("new_rows"), F.lit(0)).alias("n")).first()["n"]
    fresh = merge_incremental(stored.limit(0), bars).join(stored.select(*IDENTITY), list(IDENTITY), "left_anti")
    fresh.select(*columns).write.mode("append").parquet(f"{path}/bars")
    _describe_new(spark, f"{path}/bars", schema, keys, described)
    spark.createDataFrame([(digest, total)], known_schema).write.mode("append").parquet(f"{path}/datasets")
    return {"dataset_id": digest, "inserted": inserted, "duplicates": total - inserted}


def latest_report(reports: DataFrame, kind: str, require_candidates: bool = False, among: int = 100) -> DataFrame:
    """Newest report of a kind; optionally the newest with candidates among the last ``among``."""
    newest = reports.filter(F.col("report_type") == kind).orderBy(F.desc("created_at")).limit(among)
    if require_candidates:
        newest = newest.filter(F.size("candidates") > 0)
    return newest.orderBy(F.desc("created_at")).limit(1)


def json_safe(frame: DataFrame) -> DataFrame:
    """Values a JSON document can hold: no NaN or infinity, decimals and times as text (recursive)."""
    return frame.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema.fields])


def _safe(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # as isoformat() writes it: microseconds only where there are any
        micros = F.date_format(value, "SSSSSS")
        fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_safe(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _safe(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _safe(item, kind.valueType))
    return value
