"""Raw bars with faults planted by time slot, so that every gate has something to catch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import tables
from barloom.staging import staged

_PERIOD = 97
RAW_SQL = """slots AS (SELECT *, epoch_ms(ts)::BIGINT // 900000 AS slot FROM bars),
raw AS (
  SELECT symbol, ts, '15m' AS timeframe, CASE WHEN f = 6 THEN 0 ELSE open END AS open, high,
    CASE WHEN f = 3 THEN high + 1 ELSE low END AS low, CASE WHEN f = 5 THEN NULL ELSE close END AS close,
    CASE WHEN f = 4 THEN -volume - 1 WHEN f = 2 AND copy = 1 THEN volume + 1 ELSE volume END AS volume,
    'events' AS provider, CASE WHEN f = 7 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 15 MINUTE END AS received_at,
    slot * 4 + copy + CASE WHEN f = 8 THEN 401 ELSE 0 END AS ingest_seq, f, copy, slot
  FROM (SELECT *, slot % 97 AS f FROM slots) s, (SELECT unnest([0, 1]) AS copy) c
  WHERE copy = 0 OR f IN (1, 2))"""


def raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical raw bars; ``fault`` 1 is sent twice, 2 is revised, 3-7 break a rule, 8 comes late."""
    return staged("raw_bars", spark, folder, lambda: _plant(tables.m15_bars(spark, folder)))


def _plant(bars: DataFrame) -> DataFrame:
    slot = F.floor(F.unix_seconds("ts") / 900)
    rows = bars.withColumns({"slot": slot, "fault": slot % _PERIOD})
    copies = F.when(F.col("fault").isin(1, 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("copy", F.explode(copies))
    fault, copy = F.col("fault"), F.col("copy")
    minute = F.expr("INTERVAL 1 MINUTE")
    return rows.select(
        "symbol", "ts", F.lit("15m").alias("timeframe"),
        F.when(fault == 6, 0.0).otherwise(F.col("open")).alias("open"),
        "high",
        F.when(fault == 3, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(fault != 5, F.col("close")).alias("close"),
        F.when(fault == 4, -F.col("volume") - 1).when((fault == 2) & (copy == 1), F.col("volume") + 1)
        .otherwise(F.col("volume")).alias("volume"),
        F.lit("events").alias("provider"),
        F.when(fault == 7, F.col("ts") - minute).otherwise(F.col("ts") + minute * 15).alias("received_at"),
        F.lit(False).alias("is_adjusted"), F.lit(None).cast("string").alias("adjustment_type"),
        F.array(F.lit("RESEARCH_ONLY")).alias("quality_flags"),
        (F.col("slot") * 4 + copy + F.when(fault == 8, 401).otherwise(0)).alias("ingest_seq"),
        "fault", "copy", "slot",
    )
