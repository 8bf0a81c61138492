"""Instrument universe: refresh, provider results, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refresh(previous: DataFrame, accepted: DataFrame, snapshot_id: str, now: Column) -> DataFrame:
    """Previous universe merged with the accepted list: nothing is deleted.

    Adds ``event``: NEW_SYMBOL, UNCHANGED, INACTIVE (was active, no longer listed) or null.
    """
    old, new = previous.alias("o"), accepted.alias("n")
    joined = old.join(new, F.col("o.symbol") == F.col("n.symbol"), "full_outer")
    known, listed = F.col("o.symbol").isNotNull(), F.col("n.symbol").isNotNull()
    was_active = F.coalesce(F.col("o.active"), F.lit(False))
    event = (
        F.when(listed & ~known, "NEW_SYMBOL").when(listed, "UNCHANGED")
        .when(was_active, "INACTIVE")
    )
    return joined.select(
        F.coalesce("n.symbol", "o.symbol").alias("symbol"),
        F.coalesce("n.name", "o.name").alias("name"),
        F.coalesce("n.market", "o.market").alias("market"),
        listed.alias("active"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(listed, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        event.alias("event"), F.lit(snapshot_id).alias("snapshot_id"),
    )


def membership_events(refreshed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Membership rows of this snapshot; none when the snapshot id is stored already."""
    rows = refreshed.filter(F.col("event").isNotNull()).select("snapshot_id", "symbol", "market", "active", "event")
    return rows if stored is None else rows.join(stored.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def record_results(universe: DataFrame, results: DataFrame) -> DataFrame:
    """Provider state per symbol from a results table (symbol, failure); null failure is success."""
    joined = universe.join(results.withColumn("_seen", F.lit(True)), "symbol", "left")
    failure, seen = F.col("failure"), F.col("_seen").isNotNull()
    status = (
        F.when(~seen, F.col("provider_status")).when(failure.isNull(), "AVAILABLE")
        .when(F.contains(failure, F.lit("UNAVAILABLE")), "PROVIDER_UNAVAILABLE").otherwise("TEMPORARILY_DEGRADED")
    )
    valid = (
        F.when(~seen, F.col("validation_status")).when(failure.isNull(), "VALID").otherwise("FAILED")
    )
    return joined.withColumns({"provider_status": status, "validation_status": valid}).drop("_seen", "failure")


def coverage(universe: DataFrame, bar_stats: DataFrame, now: Column, stale_minutes: int = 45, min_bars: int = 50) -> DataFrame:
    """One row of conditional counts over the active symbols."""
    active = universe.filter("active").join(bar_stats, "symbol", "left").withColumns({
        "_fresh": F.coalesce(F.unix_micros(now) - F.unix_micros("last_ts") <= stale_minutes * 60_000_000, F.lit(False)),
        "_available": F.coalesce(F.col("provider_status") == "AVAILABLE", F.lit(False)),
        "_bars": F.coalesce("bars", F.lit(0)),
    })
    ready = F.col("_available") & F.col("_fresh") & (F.col("_bars") >= min_bars)
    out = active.agg(
        F.count(F.lit(1)).alias("total_active"), F.count_if("_available").alias("provider_available"),
        F.count_if("_fresh").alias("fresh"), F.count_if(ready).alias("eligible"),
        F.count_if(F.col("_available") & ~F.col("_fresh")).alias("stale"),
        F.count_if(F.col("provider_status") == "PROVIDER_UNAVAILABLE").alias("provider_unavailable"),
        F.count_if(F.col("_available") & (F.col("_bars") < min_bars)).alias("limited_history"),
    )
    percent = F.when(F.col("total_active") > 0, F.bround(F.col("eligible") / F.col("total_active") * 100, 2))
    return out.withColumn("coverage_percent", F.coalesce(percent, F.lit(0.0)))


def bar_stats(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars"))
