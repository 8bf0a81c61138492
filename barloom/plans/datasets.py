"""Derived tables several queries start from, computed once per session and spilled to disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features, risk, scoring, signals
from barloom.plans.common import m15_series, series
from barloom.sources import tables
from barloom.staging import staged


def daily_series(spark: SparkSession, folder: str):
    """Regions and the market-wide benchmark as one set of daily series."""
    return series(tables.day_bars(spark, folder).unionByName(tables.market_day_bars(spark, folder)), "1d")


def daily_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("daily_features", spark, folder, lambda: features.daily_features(daily_series(spark, folder)).rows())


def daily_score_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("daily_scores", spark, folder, lambda: signals.daily_scores(daily_feature_rows(spark, folder)))


def intraday_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("intraday_features", spark, folder, lambda: features.intraday_features(m15_series(spark, folder)))


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of all warmed-up bars, received 15 minutes after the bar starts."""
    rows = intraday_rows(spark, folder)
    return scoring.snapshots(rows, F.col("ts") + F.expr("INTERVAL 15 MINUTES"))


def planned_signals(spark: SparkSession, folder: str, min_score: int = 60) -> DataFrame:
    """Snapshots from the score on, with their research plan."""
    def build() -> DataFrame:
        chosen = snapshot_rows(spark, folder).filter(F.col("radar_score") >= min_score)
        return risk.plan_levels(risk.add_research_plan(chosen))
    return staged(f"planned_signals_{min_score}", spark, folder, build)


def orders(spark: SparkSession, folder: str, min_score: int = signals.MIN_SCORE) -> DataFrame:
    return staged(f"orders_{min_score}", spark, folder,
                  lambda: signals.daily_orders(daily_score_rows(spark, folder), min_score))
