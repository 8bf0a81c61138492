"""Research scan of yearly contracts against an index that starts later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import scan
from barloom.plans import sql
from barloom.plans.features import FEAT, REGIME_CASE
from barloom.schema import TIMEFRAME_SECONDS
from barloom.sources import tables
from barloom.staging import staged

_DAY = TIMEFRAME_SECONDS["1d"]


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return staged("scan_outcomes", spark, folder, lambda: scan.research_scan(
        tables.contract_bars(spark, folder), tables.index_bars(spark, folder), _DAY))


def f17_latest_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan.candidates(outcomes(spark, folder)).select(
        "symbol", "score", "signal_class", F.concat_ws("|", "reasons").alias("reasons"), "data_timestamp")


def f17_scan_refusals(spark: SparkSession, folder: str) -> DataFrame:
    return scan.refusals(outcomes(spark, folder))


def f17_scan_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes(spark, folder).drop("reasons")


QUERIES: dict[str, Callable] = {
    "f17_latest_scan": f17_latest_scan, "f17_scan_refusals": f17_scan_refusals, "f17_scan_outcomes": f17_scan_outcomes,
}

_BARS = f"""trades AS (
  SELECT n_name || '-' || year(l_shipdate) AS symbol, l_shipdate AS ts, price, l_quantity AS volume, (l_orderkey, l_linenumber, l_partkey) AS seq FROM lines
  UNION ALL SELECT n_name || '-COARSE', l_shipdate, ceil(price / 1000) * 1000.0, l_quantity, (l_orderkey, l_linenumber, l_partkey) FROM lines
  UNION ALL SELECT 'INDEX', l_shipdate, 100 + l_extendedprice / l_quantity / 1000, l_quantity, (l_orderkey, l_linenumber, l_partkey)
    FROM lineitem WHERE l_shipdate >= DATE '{tables.INDEX_LAUNCH}'),
whole AS MATERIALIZED (
  SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(volume) AS volume FROM trades GROUP BY 1, 2),
ends AS (SELECT symbol, max(ts) AS stamp, count(*) AS bars FROM whole WHERE symbol <> 'INDEX' GROUP BY 1),
tail AS (
  SELECT w.symbol, w.ts, open, high, low, close, volume, ends.bars, NULL::TIMESTAMP AS stamp FROM whole w JOIN ends USING (symbol)
    QUALIFY row_number() OVER (PARTITION BY w.symbol ORDER BY w.ts DESC) <= {scan.WINDOW}
  UNION ALL
  SELECT 'INDEX ' || s.stamp, w.ts, open, high, low, close, volume, count(*) OVER (PARTITION BY s.stamp), s.stamp
    FROM (SELECT DISTINCT stamp FROM ends WHERE bars >= {scan.WARMUP_BARS}) s JOIN whole w ON w.symbol = 'INDEX' AND w.ts <= s.stamp
    QUALIFY row_number() OVER (PARTITION BY s.stamp ORDER BY w.ts DESC) <= {scan.WINDOW}),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM tail)"""

_OUTCOMES = f"""known AS (SELECT symbol, any_value(bars) AS bars, any_value(stamp) AS stamp, max(n) AS last FROM num GROUP BY 1),
newest AS (SELECT t.*, known.bars, known.stamp FROM trended t JOIN known ON t.symbol = known.symbol AND t.n = known.last),
index_side AS (SELECT stamp, bars AS index_bars, {REGIME_CASE} AS regime, ret20 AS index_ret20 FROM newest WHERE stamp IS NOT NULL),
met AS (
  SELECT m.*, coalesce(i.index_bars, 0) AS index_bars, i.regime, (m.ret20 - i.index_ret20) * 100 AS rs,
    least(m.recent_low, m.close - m.atr * 1.2) AS raw
  FROM newest m LEFT JOIN index_side i ON m.ts = i.stamp WHERE m.stamp IS NULL),
pts AS (
  SELECT *, CASE WHEN atr > 0 AND recent_low > 0 AND raw > 0 AND raw < close THEN round_even(raw, 2) END AS level,
    CASE trend_name WHEN 'STRONG_UPTREND' THEN 15 WHEN 'UPTREND' THEN 11 WHEN 'NEUTRAL' THEN 6 WHEN 'DOWNTREND' THEN 2 ELSE 0 END
    + least(15, greatest(0, round_even((rsi - 40) / 3 + (CASE WHEN macd_histogram > 0 THEN 5 ELSE 0 END) + (CASE WHEN roc > 0 THEN 3 ELSE 0 END), 0)::INT))
    + CASE WHEN rvol >= 3 THEN 20 WHEN rvol >= 2 THEN 18 WHEN rvol >= 1.5 THEN 15 WHEN rvol >= 1 THEN 10 ELSE 4 END
    + CASE WHEN breakout AND rvol >= 1.5 AND close_quality >= 0.65 THEN 15 WHEN breakout THEN 5 ELSE 2 END
    + least(10, greatest(0, round_even(5 + rs, 0)::INT)) + CASE WHEN volatility < 0.04 THEN 4 ELSE 2 END
    + CASE regime WHEN 'RISK_ON' THEN 10 WHEN 'NEUTRAL' THEN 6 ELSE 1 END + 9 AS points,
    breakout AND rvol >= 1.5 AND close_quality >= 0.65 AS confirmed FROM met),
judged AS (
  SELECT *, CASE WHEN bars < {scan.WARMUP_BARS} THEN 'WARMUP_INCOMPLETE' WHEN index_bars < {scan.WARMUP_BARS} THEN 'MISSING_INDEX'
    WHEN level IS NULL THEN 'RISK_REWARD' WHEN points < 80 THEN 'LOW_SCORE' END AS refusal FROM pts),
outcome AS (
  SELECT *, refusal IS NULL OR refusal = 'LOW_SCORE' AS scored FROM judged),
told AS MATERIALIZED (
  SELECT symbol, ts AS data_timestamp, bars, index_bars, CASE WHEN scored THEN regime END AS regime,
    CASE WHEN scored THEN least(100, points) END::INT AS score,
    CASE WHEN scored THEN CASE WHEN points >= 90 THEN 'VERY_STRONG_CANDIDATE' WHEN points >= 80 THEN 'STRONG_CANDIDATE'
      WHEN points >= 70 THEN 'CANDIDATE' WHEN points >= 60 THEN 'WATCH' ELSE 'NO_SIGNAL' END END AS signal_class,
    CASE WHEN scored THEN level END AS stop, CASE WHEN scored THEN round_even(close + (close - level) * 1.5, 2) END AS target_1,
    CASE WHEN scored THEN round_even(close + (close - level) * 2.5, 2) END AS target_2,
    'Trend: ' || trend_name || '|Relative volume: ' || format('{{:.2f}}', rvol) || 'x|' || CASE WHEN macd_histogram > 0 THEN 'Positive' ELSE 'Negative' END
      || ' MACD momentum|' || CASE WHEN confirmed THEN 'Resistance breakout confirmed' ELSE 'No confirmed breakout' END
      || '|Market regime: ' || regime AS reasons, refusal FROM outcome)
"""
_TOLD = sql.with_(sql.LINES, _BARS, sql.recursion(), FEAT, _OUTCOMES, recursive=True)

ORACLES: dict[str, str] = {
    "f17_latest_scan": _TOLD + f"""SELECT symbol, score, signal_class, reasons, data_timestamp FROM told
WHERE score >= {scan.CANDIDATE_SCORE} ORDER BY score DESC, symbol LIMIT {scan.CANDIDATES}""",
    "f17_scan_refusals": _TOLD + "SELECT refusal, count(*) AS symbols FROM told WHERE refusal IS NOT NULL GROUP BY 1",
    "f17_scan_outcomes": _TOLD + "SELECT * EXCLUDE (reasons) FROM told",
}
