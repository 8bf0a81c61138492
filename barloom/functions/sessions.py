"""Session (UTC calendar day) and time-slot functions; a group is bounded by bars per day or days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import typical_price


def add_session_columns(bars: DataFrame) -> DataFrame:
    """``session_vwap`` and ``session_high`` so far within (symbol, UTC date)."""
    day = bars.withColumn("session", F.to_date("ts"))
    upto = (
        Window.partitionBy("symbol", "session").orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    value = F.sum(typical_price() * F.col("volume")).over(upto)
    return day.withColumns({
        "session_vwap": value / F.nullif(F.sum("volume").over(upto), F.lit(0.0)),
        "session_high": F.max("high").over(upto),
    })


def add_previous_session_high(bars: DataFrame) -> DataFrame:
    """High of the last session that is present before the bar's own session."""
    day = bars if "session" in bars.columns else bars.withColumn("session", F.to_date("ts"))
    highs = day.groupBy("symbol", "session").agg(F.max("high").alias("_high"))
    over = Window.partitionBy("symbol").orderBy("session")  # one row per session
    previous = highs.select("symbol", "session", F.lag("_high").over(over).alias("previous_session_high"))
    return day.join(previous, ["symbol", "session"])


def add_slot_relative_volume(bars: DataFrame, lookback: int = 20, fallback: str | None = None) -> DataFrame:
    """Volume over the mean of the previous ``lookback`` bars of the same HH:MM slot.

    A symbol whose slots have no such history uses the column ``fallback`` for all its bars (a
    rolling relative volume computed before).  Adds ``rvol`` and ``rvol_method``.
    """
    slotted = bars.withColumn("_slot", F.date_format("ts", "HH:mm"))
    before = Window.partitionBy("symbol", "_slot").orderBy("ts").rowsBetween(-lookback, -1)
    mean = F.when(F.count("volume").over(before) == lookback, F.avg("volume").over(before))
    slotted = slotted.withColumn("_mean", mean)
    # A slot has history once it holds more than ``lookback`` bars; counted with partial aggregation.
    per_slot = bars.groupBy("symbol", F.date_format("ts", "HH:mm").alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = per_slot.groupBy("symbol").agg((F.max("_n") > lookback).alias("_known"))
    out = slotted.join(known, "symbol").withColumns({
        "rvol": F.when(F.col("_known"), F.col("volume") / F.nullif("_mean", F.lit(0.0)))
        .otherwise(F.col(fallback) if fallback else F.lit(None).cast("double")),
        "rvol_method": F.when(F.col("_known"), "HISTORICAL_BAR_SLOT").otherwise("ROLLING_FALLBACK"),
    })
    return out.drop("_slot", "_mean", "_known")
