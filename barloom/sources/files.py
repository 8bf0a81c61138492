"""File sources: CSV and Parquet bars, the universe list, and cache manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.quality import latest_rows
from barloom.schema import BAR_CSV, UNIVERSE_CSV


def csv_bars(spark: SparkSession, folder: str, start: Column | None = None, end: Column | None = None,
             symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with the declared schema; the range is inclusive at both ends."""
    rows = spark.read.schema(BAR_CSV).option("header", True).csv(folder).withColumnRenamed("timestamp", "ts")
    return _narrow(rows, start, end, symbol)


def csv_tail(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The last ``limit`` bars of every symbol."""
    return latest_rows(csv_bars(spark, folder), limit).drop("rank")


def parquet_bars(spark: SparkSession, folder: str, start: Column | None = None, end: Column | None = None,
                 symbol: str | None = None) -> DataFrame:
    """Bars from a Parquet table partitioned by symbol; symbol and range reach the scan."""
    return _narrow(spark.read.parquet(folder), start, end, symbol)


def _narrow(rows: DataFrame, start: Column | None, end: Column | None, symbol: str | None) -> DataFrame:
    if symbol is not None:
        rows = rows.filter(F.col("symbol") == symbol)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    return rows if end is None else rows.filter(F.col("ts") <= end)


def stored_bars(table: DataFrame, dataset_id: str | None = None, provider: str | None = None,
                timeframe: str | None = None, active: DataFrame | None = None) -> DataFrame:
    """Stored bars by data set, provider and timeframe, limited to active symbols when any exist."""
    for name, value in (("dataset_id", dataset_id), ("provider", provider), ("timeframe", timeframe)):
        if value is not None:
            table = table.filter(F.col(name) == value)
    if active is None or active.isEmpty():
        return table
    return table.join(active.select("symbol").distinct(), "symbol", "left_semi")


# Spellings that count as true, and the allowed code characters.
TRUE_WORDS = ("1", "true", "yes")
CODE_PATTERN = "^[A-Z0-9_]*[A-Z0-9][A-Z0-9_]*$"


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Members from the universe CSV; a file with other columns is refused."""
    raw = spark.read.option("header", True).csv(path)
    if set(raw.columns) != set(UNIVERSE_CSV.names):
        raise ValueError("invalid universe schema")
    return universe_members(raw)


def universe_members(raw: DataFrame) -> DataFrame:
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in UNIVERSE_CSV.names}
    rows = raw.withColumns(text)
    return rows.select(
        F.upper(F.trim("symbol")).alias("symbol"),
        F.nullif("name", F.lit("")).alias("name"),
        F.nullif("sector", F.lit("")).alias("sector"),
        F.lower("active").isin(*TRUE_WORDS).alias("active"),
        "source",
        F.to_date("source_date").alias("source_date"),
    )


def universe_problems(members: DataFrame) -> DataFrame:
    """One row of counts; both must be zero for an acceptable universe."""
    per_code = members.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return per_code.agg(
        F.coalesce(F.sum(F.when(~F.col("symbol").rlike(CODE_PATTERN), F.col("_n"))), F.lit(0)).alias("invalid_symbols"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_symbols"),
    )


def universe_hash(members: DataFrame, leaf: int = 64) -> DataFrame:
    """Order-free snapshot hash by a tree whose depth follows the number of different rows.

    A row's hash falls into a leaf by its first hex digits, as many as leave about ``leaf`` rows in each;
    a leaf hashes its rows in order, with how often each occurs, and every level above hashes its at most
    sixteen children.  So no group grows with the table, and repeated rows are counted, not listed.
    """
    line = F.concat_ws("|", "symbol", F.coalesce("name", F.lit("")), F.coalesce("sector", F.lit("")),
                       F.col("active").cast("string"), "source", F.col("source_date").cast("string"))
    rows = members.groupBy(F.sha2(line, 256).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    depth = 1
    while leaf * 16**depth < rows.count() and depth < 12:
        depth += 1
    nodes = rows.select(F.substring("_r", 1, depth).alias("_p"), F.concat_ws(":", "_r", F.col("_n").cast("string")).alias("_h"))
    digest = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("_h"))), 256)
    for level in range(depth, 0, -1):
        folded = nodes.groupBy("_p").agg(digest.alias("_h"))
        nodes = folded.select(F.substring("_p", 1, level - 1).alias("_p"), F.concat_ws(":", "_p", "_h").alias("_h"))
    return nodes.agg(digest.alias("snapshot_hash"))  # at most sixteen


def usable_cache(manifest: DataFrame, found: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Cache entries that may be reused: present, young enough and with an unchanged content hash.

    ``manifest`` has key, saved_at, content_hash; ``found`` has key and the hash of what is there.
    """
    age = F.unix_micros(now) - F.unix_micros("saved_at")
    return manifest.join(found.withColumnRenamed("content_hash", "_found"), "key").filter(
        (age <= ttl_seconds * 1_000_000) & (F.col("content_hash") == F.col("_found"))
    ).drop("_found")
