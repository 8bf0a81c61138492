"""Research scan: every symbol at its own last bar, from bounded tails only.

A recursive mean over a tail is seeded at the tail's first bar, so a scan needs the last ``WINDOW``
bars of a symbol and nothing before them.  The benchmark is cut the same way, once for each moment
at which some symbol ends: its tail up to that moment has seeds of its own.  A tail is one small
group, and neither the symbol's nor the benchmark's length matters beyond finding the tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import features, risk, scoring
from barloom.operators.joins import as_of
from barloom.series import SLICE_BARS, blocked, epoch_slice

# Bars before a symbol is scanned, bars of a tail, and scores of orders and candidates.
WARMUP_BARS, WINDOW = 200, 260
ORDER_SCORE, CANDIDATE_SCORE, CANDIDATES = 80, 70, 10
WARMUP, NO_INDEX, NO_PLAN, LOW = "WARMUP_INCOMPLETE", "MISSING_INDEX", "RISK_REWARD", "LOW_SCORE"
BAR = ("ts", "open", "high", "low", "close", "volume")


def tails(numbered: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last ``window`` bars of every symbol, numbered from 0; ``bars`` is the symbol's whole count."""
    ends = numbered.groupBy("symbol").agg((F.max("bar_no") + 1).alias("bars"))
    first = F.greatest(F.col("bars") - window, F.lit(0))
    return (
        numbered.select("symbol", "bar_no", *BAR).join(ends, "symbol").filter(F.col("bar_no") >= first)
        .withColumn("bar_no", F.col("bar_no") - first)
    )


def tails_as_of(stamps: DataFrame, benchmark: DataFrame, step_seconds: int, window: int = WINDOW) -> DataFrame:
    """For each stamp the benchmark's last ``window`` bars up to it, numbered from 0.

    ``stamps`` has one distinct column ``ts``; the result is named by the stamp, ``stamp``.  A stamp
    before the benchmark's first bar has no rows.  Stamps and bars meet in numbered runs of ``window``
    bars, each stamp in the two runs that its tail can touch.
    """
    upto = as_of(stamps, benchmark.select("ts", "bar_no"), [], epoch_slice("ts", step_seconds * SLICE_BARS), ["bar_no"])
    upto = upto.filter(F.col("bar_no").isNotNull()).select(F.col("ts").alias("stamp"), F.col("bar_no").alias("_last"))
    run = F.floor(F.col("_last") / window)
    asked = upto.withColumn("_run", F.explode(F.sequence(F.greatest(run - 1, F.lit(0)), run)))
    first = F.greatest(F.col("_last") - window + 1, F.lit(0))
    met = asked.join(benchmark.select("bar_no", *BAR).withColumn("_run", F.floor(F.col("bar_no") / window)), "_run")
    return met.filter((F.col("bar_no") >= first) & (F.col("bar_no") <= F.col("_last"))).select(
        "stamp", (F.col("bar_no") - first).alias("bar_no"), (F.col("_last") + 1).alias("bars"), *BAR
    )


def _last_features(tail: DataFrame, key: str) -> DataFrame:
    """Features of the last bar of each tail."""
    series = blocked(tail.withColumnRenamed(key, "symbol"), 32)
    rows = features.daily_features(series).rows()
    return rows.filter(F.col("bar_no") == F.least(F.col("bars"), F.lit(WINDOW)) - 1).withColumnRenamed("symbol", key)


def _exact_targets(planned: DataFrame) -> DataFrame:
    """Targets rounded to the cent in decimals: levels halfway between two cents are common in coarse prices."""
    entry, stop = F.col("close").cast("decimal(20,8)"), F.col("stop").cast("decimal(20,8)")
    return planned.withColumns({
        name: F.bround(entry + (entry - stop) * F.lit(multiple).cast("decimal(2,1)"), 2).cast("double")
        for name, multiple in (("target_1", risk.FIRST_TARGET_R), ("target_2", risk.SECOND_TARGET_R))
    })


def research_scan(numbered: DataFrame, benchmark: DataFrame, step_seconds: int, warmup: int = WARMUP_BARS) -> DataFrame:
    """One row per symbol: its last time, its number of bars, the score, and why no order follows.

    ``refusal`` is the first reason that holds: too few bars of the symbol, too few bars of the
    benchmark up to the symbol's last time, no valid trade plan, or a score below ``ORDER_SCORE``; it
    is null where an order follows.  The score is null for the first three.  Without a benchmark all
    symbols of enough bars lack their index.
    """
    mine = _last_features(tails(numbered), "symbol")
    stamps = mine.filter(F.col("bars") >= warmup).select("ts").distinct()
    index = _last_features(tails_as_of(stamps, benchmark, step_seconds), "stamp").withColumn("_trend", scoring.trend()).select(
        F.col("stamp").alias("ts"), F.col("bars").alias("index_bars"), scoring.regime("_trend").alias("regime"), F.col("ret20").alias("_index_ret20"),
    )
    rows = risk.add_trade_plan(mine.join(index, "ts", "left").withColumns({
        "trend_name": scoring.trend(), "relative_strength": (F.col("ret20") - F.col("_index_ret20")) * 100,
        "data_status": F.lit("OK"), "data_quality": F.lit(100.0),
    }))
    scored = _exact_targets(scoring.score_daily(rows))
    refusal = (
        F.when(F.col("bars") < warmup, WARMUP)
        .when(F.coalesce("index_bars", F.lit(0)) < warmup, NO_INDEX)
        .when(F.col("stop").isNull(), NO_PLAN)
        .when(F.col("score") < ORDER_SCORE, LOW)
    )
    found = F.coalesce(~F.col("refusal").isin(WARMUP, NO_INDEX, NO_PLAN), F.lit(True))
    return scored.withColumn("refusal", refusal).select(
        "symbol", F.col("ts").alias("data_timestamp"), "bars", F.coalesce("index_bars", F.lit(0)).cast("long").alias("index_bars"),
        *[F.when(found, F.col(c)).alias(c) for c in ("regime", "score", "signal_class", "stop", "target_1", "target_2", "reasons")], "refusal",
    )


def candidates(outcomes: DataFrame, least: int = CANDIDATE_SCORE, most: int = CANDIDATES) -> DataFrame:
    """The report's best symbols, by falling score and then by name."""
    return outcomes.filter(F.col("score") >= least).orderBy(F.desc("score"), "symbol").limit(most)


def refusals(outcomes: DataFrame) -> DataFrame:
    """Number of symbols refused for each reason."""
    return outcomes.filter("refusal IS NOT NULL").groupBy("refusal").agg(F.count(F.lit(1)).alias("symbols"))
