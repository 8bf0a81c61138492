"""Risk plan queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features as feat
from barloom.operators import quality, risk
from barloom.plans import datasets as data

from barloom.plans.features import SCORES
from barloom.plans.labels import signals_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


_STOP = """SELECT symbol, ts, CASE WHEN atr > 0 AND recent_low > 0 AND least(recent_low, close - atr * 1.2) > 0 AND least(recent_low, close - atr * 1.2) < close
  THEN round_even(least(recent_low, close - atr * 1.2), 2) END AS stop, close FROM feat WHERE symbol <> 'MARKET'"""


@query("r01_stop", SCORES + f"SELECT symbol, ts, stop FROM ({_STOP})")
def r01(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.daily_feature_rows(spark, folder).filter(F.col("symbol") != "MARKET")
    return risk.add_trade_plan(rows).select("symbol", "ts", "stop")


@query("r02_trade_plan", SCORES + f"""
SELECT symbol, ts, round(stop, 2) AS stop, round_even(close + (close - stop) * 1.5, 2) AS target_1, round_even(close + (close - stop) * 2.5, 2) AS target_2,
  CASE WHEN stop IS NOT NULL THEN 2.5 END AS risk_reward FROM ({_STOP})""")
def r02(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.daily_feature_rows(spark, folder).filter(F.col("symbol") != "MARKET")
    return risk.add_trade_plan(rows).select("symbol", "ts", "stop", "target_1", "target_2", "risk_reward")


@query("r03_position_size", SCORES + f"""
SELECT symbol, ts, CASE WHEN stop > 0 AND close > stop AND (close - stop) / close * 100 >= 0.10
  THEN least(floor(100000.0 * 0.75 / 100 / (close - stop)), floor(100000.0 * 20.0 / 100 / close))::BIGINT END AS quantity FROM ({_STOP})""")
def r03(spark: SparkSession, folder: str) -> DataFrame:
    rows = risk.add_trade_plan(data.daily_feature_rows(spark, folder).filter(F.col("symbol") != "MARKET"))
    size = risk.position_size(F.lit(risk.EQUITY), F.col("entry"), F.col("stop"))
    return rows.select("symbol", "ts", size.cast("long").alias("quantity"))


_PLAN_SQL = """SELECT signal_id, plan_status, zone_low, zone_high, CASE WHEN qty IS NOT NULL THEN round_even(bo, 2) END AS breakout_trigger, stop, t1, t2, t3,
  CASE WHEN qty IS NOT NULL THEN round_even((en - st) / en * 100, 2) END AS stop_distance_percent, CASE WHEN qty IS NOT NULL THEN 2.5 END AS risk_reward, qty::BIGINT AS quantity,
  CASE WHEN qty IS NOT NULL THEN round_even(qty * en, 2) END AS position_value FROM sig"""


def _plan_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "signal_id", "plan_status", "zone_low", "zone_high", F.col("plan.breakout_trigger"), "stop", "t1", "t2", "t3",
        F.col("plan.stop_distance_percent"), F.col("plan.risk_reward"),
        F.col("plan.position_sizing.estimated_quantity").alias("quantity"),
        F.col("plan.position_sizing.suggested_position_value").alias("position_value"))


@query("r04_research_plan", signals_sql() + _PLAN_SQL)
def r04(spark: SparkSession, folder: str) -> DataFrame:
    return _plan_view(data.planned_signals(spark, folder))


@query("r05_candidate_plans", signals_sql(0) + f"""
SELECT p.*, true AS market_closed FROM ({_PLAN_SQL}) p JOIN (SELECT signal_id FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) USING (signal_id)""")
def r05(spark: SparkSession, folder: str) -> DataFrame:
    """Newest snapshot of every symbol with the lows of its last ten bars, seen after hours."""
    newest = feat.last_bar(data.snapshot_rows(spark, folder))
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    planned = risk.plan_levels(risk.add_research_plan(newest))
    return _plan_view(planned).withColumn("market_closed", ~quality.in_session(now))
