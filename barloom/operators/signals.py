"""Signal tables: daily scores joined with the benchmark, and 15-minute snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import risk, scoring
from barloom.operators.features import add_benchmark_return

WARMUP_BARS = 200
MIN_SCORE = 80


def split_benchmark(features: DataFrame, name: str = "MARKET", warmup: int = WARMUP_BARS) -> tuple[DataFrame, DataFrame]:
    """Instrument rows, and the benchmark's regime and 20-bar return per time."""
    market = (
        features.filter((F.col("symbol") == name) & (F.col("bar_no") >= warmup - 1))
        .withColumn("market_trend", scoring.trend())
        .select("ts", scoring.regime("market_trend").alias("regime"), F.col("ret20").alias("market_ret20"))
    )
    return features.filter(F.col("symbol") != name), market


def daily_scores(features: DataFrame, benchmark: str = "MARKET", warmup: int = WARMUP_BARS) -> DataFrame:
    """Every warmed-up bar of a daily feature table with a benchmark row and a valid plan, scored."""
    rows, market = split_benchmark(features, benchmark, warmup)
    rows = rows.filter(F.col("bar_no") >= warmup - 1).withColumn("trend_name", scoring.trend())
    joined = add_benchmark_return(rows, market).join(market.select("ts", "regime"), "ts")
    planned = risk.add_trade_plan(joined).filter(F.col("stop").isNotNull())
    planned = planned.withColumns({"data_status": F.lit("OK"), "data_quality": F.lit(100.0)})
    return scoring.score_daily(planned)


def daily_orders(scores: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Orders for the next bar: deterministic ids, levels and score."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+00:00")
    return scores.filter(F.col("score") >= min_score).select(
        F.concat_ws("-", "symbol", stamp).alias("signal_id"),
        F.concat_ws(":", F.lit(scoring.DAILY_STRATEGY), "symbol", stamp).alias("idempotency_key"),
        "symbol", F.col("ts").alias("signal_time"), "bar_no", F.col("entry").alias("expected_entry"),
        "stop", "target_1", "target_2", "score", F.lit(100).alias("data_quality"), "regime",
    )


def apply_strategy(features: DataFrame, strategy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Orders of a user strategy: a function from a feature table to rows like ``daily_orders``."""
    orders = strategy(features)
    missing = {"symbol", "signal_time", "bar_no", "expected_entry", "stop", "target_1", "target_2", "score"} - set(orders.columns)
    if missing:
        raise ValueError(f"strategy output lacks {sorted(missing)}")
    return orders
