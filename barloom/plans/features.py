"""Feature tables, scores, text and alert queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import features as feat
from barloom.operators import quality, risk, scoring, signals
from barloom.plans import datasets as data
from barloom.plans import sql
from barloom.plans.common import r
from barloom.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# --- daily ----------------------------------------------------------------------------------

ALL_DAY = sql.LINES + ", " + sql.MARKET + """, bars AS (
  SELECT r_name AS symbol, l_shipdate AS ts, arg_min(price, (l_orderkey, l_linenumber, l_partkey)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (l_orderkey, l_linenumber, l_partkey)) AS close,
         sum(l_quantity) AS volume FROM lines GROUP BY 1, 2
  UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM market)"""

FEAT = """feat AS MATERIALIZED (
  SELECT *, coalesce(close > ema20, false) AS price_above_ema20, coalesce(close > ema50, false) AS price_above_ema50,
    coalesce(close > ema200, false) AS price_above_ema200, coalesce(ema20 > ema50, false) AS ema20_above_ema50,
    coalesce(ema50 > ema200, false) AS ema50_above_ema200,
    coalesce(high > lag(high, 5) OVER w, false) AS higher_high, coalesce(low > lag(low, 5) OVER w, false) AS higher_low,
    ema20 - lag(ema20, 5) OVER w AS ema20_slope, ema50 - lag(ema50, 5) OVER w AS ema50_slope,
    macd - lag(macd, 3) OVER w AS macd_slope, (close / lag(close, 10) OVER w - 1) * 100 AS roc,
    CASE WHEN n >= 20 THEN volume / nullif(avg(volume) OVER p20, 0) END AS rvol,
    CASE WHEN n >= 20 THEN close > max(high) OVER p20 ELSE false END AS breakout,
    (close - low) / greatest(high - low, 1e-9) AS close_quality,
    CASE WHEN n >= 20 THEN stddev_pop(ret) OVER l20 END AS volatility,
    CASE WHEN n >= 10 THEN min(low) OVER p10 END AS recent_low, close / lag(close, 20) OVER w - 1 AS ret20
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ind)
  WINDOW w AS (PARTITION BY symbol ORDER BY ts),
    p20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    l20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    p10 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
trended AS (
  SELECT *, CASE WHEN k >= 6 AND ema20_slope > 0 THEN 'STRONG_UPTREND' WHEN k >= 4 THEN 'UPTREND'
    WHEN k <= 1 AND ema20_slope < 0 THEN 'STRONG_DOWNTREND' WHEN k <= 2 THEN 'DOWNTREND' ELSE 'NEUTRAL' END AS trend_name
  FROM (SELECT *, price_above_ema20::INT + price_above_ema50::INT + price_above_ema200::INT + ema20_above_ema50::INT
    + ema50_above_ema200::INT + higher_high::INT + higher_low::INT AS k FROM feat))"""

REGIME_CASE = """CASE WHEN trend_name IN ('STRONG_UPTREND', 'UPTREND') AND rsi >= 50 THEN 'RISK_ON'
    WHEN trend_name IN ('STRONG_DOWNTREND', 'DOWNTREND') AND rsi < 45 THEN 'RISK_OFF' ELSE 'NEUTRAL' END"""

SCORED = f"""reg AS (SELECT ts, {REGIME_CASE} AS regime, ret20 AS market_ret20 FROM trended WHERE symbol = 'MARKET' AND n >= 199),
planned AS (
  SELECT t.*, regime, (ret20 - market_ret20) * 100 AS relative_strength,
    CASE WHEN atr > 0 AND recent_low > 0 AND least(recent_low, close - atr * 1.2) > 0 AND least(recent_low, close - atr * 1.2) < close
         THEN round_even(least(recent_low, close - atr * 1.2), 2) END AS stop
  FROM trended t JOIN reg ON t.ts = reg.ts WHERE symbol <> 'MARKET' AND n >= 199 AND market_ret20 IS NOT NULL),
parts AS (
  SELECT *, CASE trend_name WHEN 'STRONG_UPTREND' THEN 15 WHEN 'UPTREND' THEN 11 WHEN 'NEUTRAL' THEN 6 WHEN 'DOWNTREND' THEN 2 ELSE 0 END AS c_trend,
    least(15, greatest(0, round_even((rsi - 40) / 3 + (CASE WHEN macd_histogram > 0 THEN 5 ELSE 0 END) + (CASE WHEN roc > 0 THEN 3 ELSE 0 END), 0)::INT)) AS c_momentum,
    CASE WHEN rvol >= 3 THEN 20 WHEN rvol >= 2 THEN 18 WHEN rvol >= 1.5 THEN 15 WHEN rvol >= 1 THEN 10 ELSE 4 END AS c_relative_volume,
    CASE WHEN breakout AND rvol >= 1.5 AND close_quality >= 0.65 THEN 15 WHEN breakout THEN 5 ELSE 2 END AS c_breakout,
    least(10, greatest(0, round_even(5 + relative_strength, 0)::INT)) AS c_relative_strength,
    CASE WHEN volatility < 0.04 THEN 4 ELSE 2 END AS c_volatility,
    CASE regime WHEN 'RISK_ON' THEN 10 WHEN 'NEUTRAL' THEN 6 ELSE 1 END AS c_market_regime,
    9 - 1 + CAST(2.5 * 3.5 >= 8.5 AS INT) AS c_risk_reward
  FROM planned WHERE stop IS NOT NULL),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN score >= 90 THEN 'VERY_STRONG_CANDIDATE' WHEN score >= 80 THEN 'STRONG_CANDIDATE' WHEN score >= 70 THEN 'CANDIDATE'
    WHEN score >= 60 THEN 'WATCH' ELSE 'NO_SIGNAL' END AS signal_class,
    round_even(close + (close - stop) * 1.5, 2) AS target_1, round_even(close + (close - stop) * 2.5, 2) AS target_2
  FROM (SELECT *, least(100, c_trend + c_momentum + c_relative_volume + c_breakout + c_relative_strength + c_volatility
    + c_market_regime + c_risk_reward) AS score FROM parts))"""

DAILY = sql.with_(ALL_DAY, sql.NUMBERED, sql.recursion(), FEAT, recursive=True)
SCORES = sql.with_(ALL_DAY, sql.NUMBERED, sql.recursion(), FEAT, SCORED, recursive=True)

_ROUNDED = [c for c in feat.DAILY_NUMBERS]
_PICK = ", ".join(list(feat.DAILY_FLAGS) + [f"round({c}, 4) AS {c}" for c in _ROUNDED])


def _daily_view(frame: DataFrame) -> DataFrame:
    return frame.select("symbol", "ts", *feat.DAILY_FLAGS, *[r(c, 4).alias(c) for c in _ROUNDED])


def f01_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return _daily_view(data.daily_feature_rows(spark, folder))


def f02_latest_features(spark: SparkSession, folder: str) -> DataFrame:
    return _daily_view(feat.last_bar(data.daily_feature_rows(spark, folder)))


def f03_trend(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.daily_feature_rows(spark, folder)
    return rows.select("symbol", "ts", scoring.trend().alias("trend_name"))


def f04_regime(spark: SparkSession, folder: str) -> DataFrame:
    _, market = signals.split_benchmark(data.daily_feature_rows(spark, folder))
    return market.select("ts", "regime")


def f05_score(spark: SparkSession, folder: str) -> DataFrame:
    scores = data.daily_score_rows(spark, folder)
    parts = [F.col(f"components.{c}").cast("int").alias(f"c_{c}") for c in scoring.COMPONENTS]
    return scores.select("symbol", "ts", *parts, "score", F.concat_ws("|", "reasons").alias("reasons"))


def f06_signal_class(spark: SparkSession, folder: str) -> DataFrame:
    scores = data.daily_score_rows(spark, folder)
    return scores.groupBy("signal_class").agg(
        F.count(F.lit(1)).alias("signals"), F.min("score").alias("low"), F.max("score").alias("high")
    )


QUERIES |= {
    "f01_feature_table": f01_feature_table, "f02_latest_features": f02_latest_features,
    "f03_trend": f03_trend, "f04_regime": f04_regime, "f05_score": f05_score,
    "f06_signal_class": f06_signal_class,
}
ORACLES["f01_feature_table"] = DAILY + f"SELECT symbol, ts, {_PICK} FROM feat"
ORACLES["f02_latest_features"] = DAILY + (
    f"SELECT symbol, ts, {_PICK} FROM feat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
ORACLES["f03_trend"] = DAILY + "SELECT symbol, ts, trend_name FROM trended"
ORACLES["f04_regime"] = SCORES + "SELECT ts, regime FROM reg"
ORACLES["f05_score"] = SCORES + (
    "SELECT symbol, ts, " + ", ".join(f"c_{c}" for c in scoring.COMPONENTS) + """, score,
  'Trend: ' || trend_name || '|Relative volume: ' || format('{:.2f}', rvol) || 'x|'
  || CASE WHEN macd_histogram > 0 THEN 'Positive' ELSE 'Negative' END || ' MACD momentum|'
  || CASE WHEN c_breakout = 15 THEN 'Resistance breakout confirmed' ELSE 'No confirmed breakout' END
  || '|Market regime: ' || regime AS reasons FROM scored""")
ORACLES["f06_signal_class"] = SCORES + (
    "SELECT signal_class, count(*) AS signals, min(score) AS low, max(score) AS high FROM scored GROUP BY 1")


# --- scans ----------------------------------------------------------------------------------

def f16_daily_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol at its last bar; failed validation gives score 0 with the failing status."""
    features = data.daily_feature_rows(spark, folder)
    newest = feat.last_bar(features)
    market = newest.filter(F.col("symbol") == "MARKET").withColumn("market_trend", scoring.trend()).select(
        scoring.regime("market_trend").alias("regime"), F.col("ret20").alias("market_ret20"))
    state = quality.validate_series(
        tables.day_bars(spark, folder).withColumn("ingest_seq", F.unix_micros("ts")),
        F.lit("2002-01-01").cast("timestamp"), stale_seconds=5000 * 86400, max_jump_percent=100.0,
    )
    rows = newest.filter(F.col("symbol") != "MARKET").join(state, "symbol").crossJoin(F.broadcast(market))
    rows = risk.add_trade_plan(rows.withColumns({
        "trend_name": scoring.trend(),
        "relative_strength": (F.col("ret20") - F.col("market_ret20")) * 100,
    }))
    rows = rows.withColumns({
        "risk_reward": F.coalesce("risk_reward", F.lit(0.0)),
        "data_status": F.col("status"), "data_quality": F.col("quality_score"),
    })
    return scoring.score_daily(rows).select("symbol", "score", "signal_class", "data_status", "data_quality")


QUERIES["f16_daily_scan"] = f16_daily_scan
ORACLES["f16_daily_scan"] = SCORES + f""",
jumps AS (SELECT symbol, max(abs(close / p - 1) * 100) > 100 AS jumped, NOT regexp_full_match(symbol, '[A-Z0-9]{{2,12}}') AS named FROM
  (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) GROUP BY symbol),
state AS (SELECT symbol, CASE WHEN jumped OR named THEN 'INVALID' ELSE 'OK' END AS data_status,
  100.0 - 20 * (jumped::INT + named::INT) AS data_quality FROM jumps),
lasts AS (SELECT *, {REGIME_CASE} AS own_regime FROM trended QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
mk AS (SELECT own_regime AS regime, ret20 AS m FROM lasts WHERE symbol = 'MARKET'),
lp AS (SELECT lasts.*, state.data_status, state.data_quality, mk.regime, (ret20 - m) * 100 AS rs,
    least(recent_low, close - atr * 1.2) AS raw FROM lasts JOIN state ON lasts.symbol = state.symbol, mk WHERE lasts.symbol <> 'MARKET'),
fin AS (SELECT *, CASE WHEN data_status = 'OK' AND data_quality >= 90 AND raw > 0 AND raw < close AND atr > 0 THEN
    least(100, CASE trend_name WHEN 'STRONG_UPTREND' THEN 15 WHEN 'UPTREND' THEN 11 WHEN 'NEUTRAL' THEN 6 WHEN 'DOWNTREND' THEN 2 ELSE 0 END
    + least(15, greatest(0, round_even((rsi - 40) / 3 + (CASE WHEN macd_histogram > 0 THEN 5 ELSE 0 END) + (CASE WHEN roc > 0 THEN 3 ELSE 0 END), 0)::INT))
    + CASE WHEN rvol >= 3 THEN 20 WHEN rvol >= 2 THEN 18 WHEN rvol >= 1.5 THEN 15 WHEN rvol >= 1 THEN 10 ELSE 4 END
    + CASE WHEN breakout AND rvol >= 1.5 AND close_quality >= 0.65 THEN 15 WHEN breakout THEN 5 ELSE 2 END
    + least(10, greatest(0, round_even(5 + rs, 0)::INT)) + CASE WHEN volatility < 0.04 THEN 4 ELSE 2 END
    + CASE regime WHEN 'RISK_ON' THEN 10 WHEN 'NEUTRAL' THEN 6 ELSE 1 END + 9) ELSE 0 END AS score FROM lp)
SELECT symbol, score, CASE WHEN score >= 90 THEN 'VERY_STRONG_CANDIDATE' WHEN score >= 80 THEN 'STRONG_CANDIDATE'
  WHEN score >= 70 THEN 'CANDIDATE' WHEN score >= 60 THEN 'WATCH' ELSE 'NO_SIGNAL' END AS signal_class, data_status, data_quality FROM fin"""



# --- 15-minute ------------------------------------------------------------------------------

INTRADAY_SQL = """sess AS (
  SELECT *, CAST(ts AS DATE) AS d, strftime(ts, '%H:%M') AS slot FROM ind),
daymax AS (SELECT symbol, d, lag(h) OVER (PARTITION BY symbol ORDER BY d) AS prev_h FROM
  (SELECT symbol, d, max(high) AS h FROM sess GROUP BY 1, 2)),
roll AS (
  SELECT s.*, prev_h, CASE WHEN count(*) OVER s20 = 20 THEN avg(volume) OVER s20 END AS slot_mean,
    CASE WHEN count(*) OVER p20 >= 5 THEN avg(volume) OVER p20 END AS roll_mean,
    CASE WHEN n >= 20 THEN max(high) OVER p20 END AS prior_high, min(low) OVER l10 AS low10,
    volume / nullif(lag(volume) OVER w, 0) - 1 AS volume_acceleration, lag(volume) OVER w AS previous_volume,
    (close / lag(close) OVER w - 1) - (lag(close) OVER w / lag(close, 2) OVER w - 1) AS price_acceleration,
    sum((high + low + close) / 3 * volume) OVER dw / nullif(sum(volume) OVER dw, 0) AS session_vwap,
    max(high) OVER dw AS session_high
  FROM sess s JOIN daymax m ON s.symbol = m.symbol AND s.d = m.d
  WINDOW w AS (PARTITION BY s.symbol ORDER BY ts), dw AS (PARTITION BY s.symbol, s.d ORDER BY ts),
    s20 AS (PARTITION BY s.symbol, slot ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    p20 AS (PARTITION BY s.symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    l10 AS (PARTITION BY s.symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
known AS (SELECT symbol, bool_or(slot_mean IS NOT NULL) AS k FROM roll GROUP BY 1),
ifeat AS MATERIALIZED (
  SELECT roll.*, coalesce(volume / nullif(CASE WHEN k THEN slot_mean ELSE roll_mean END, 0), 1.0) AS rvol,
    CASE WHEN k THEN 'HISTORICAL_BAR_SLOT' ELSE 'ROLLING_FALLBACK' END AS rvol_method,
    (close / session_vwap - 1) * 100 AS vwap_distance, (close / ema9 - 1) * 100 AS ema9_distance,
    (close / ema20 - 1) * 100 AS ema20_distance, (close / ema50 - 1) * 100 AS ema50_distance,
    (close / prior_high - 1) * 100 AS breakout_distance, (close / session_high - 1) * 100 AS day_high_distance,
    coalesce((close / prev_h - 1) * 100, 0) AS previous_day_high_distance
  FROM roll JOIN known ON roll.symbol = known.symbol WHERE n >= 49),
snap AS MATERIALIZED (
  SELECT 'radar-intraday-v1:' || symbol || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS signal_id, *, close AS price,
    least(100, greatest(0, greatest(0, least(25, floor((rsi - 35) / 2)::INT))
      + CASE WHEN ema9_distance >= 0 THEN 7 ELSE 0 END + CASE WHEN ema20_distance >= 0 THEN 7 ELSE 0 END
      + CASE WHEN ema50_distance >= 0 THEN 7 ELSE 0 END
      + CASE WHEN rvol >= 2 THEN 25 WHEN rvol >= 1.5 THEN 18 ELSE 10 END
      + CASE WHEN breakout_distance >= 0 THEN 18 WHEN breakout_distance >= -1 THEN 10 ELSE 2 END
      + CASE WHEN macd_histogram > 0 THEN 11 ELSE 0 END)) AS radar_score,
    least(100, CASE WHEN rvol >= 1.5 THEN 18 WHEN rvol >= 1 THEN 9 ELSE 0 END
      + CASE WHEN volume_acceleration > 0.25 OR (previous_volume = 0 AND volume > 0) THEN 15 ELSE 5 END
      + CASE WHEN price_acceleration > 0 THEN 14 ELSE 0 END + CASE WHEN vwap_distance >= 0 THEN 12 ELSE 0 END
      + CASE WHEN ema9_distance >= 0 THEN 12 ELSE 0 END + CASE WHEN ema20_distance >= 0 THEN 10 ELSE 0 END
      + CASE WHEN breakout_distance >= -0.5 THEN 12 ELSE 0 END + CASE WHEN macd_histogram > 0 THEN 7 ELSE 0 END) AS early_momentum_score
  FROM ifeat)"""
INTRADAY = sql.with_(sql.M15, sql.NUMBERED, sql.recursion(), INTRADAY_SQL, recursive=True)
CLASS_CASE = """CASE WHEN radar_score >= 90 THEN 'VERY_STRONG_CANDIDATE' WHEN radar_score >= 80 THEN 'STRONG_CANDIDATE'
  WHEN radar_score >= 70 THEN 'CANDIDATE' WHEN radar_score >= 60 THEN 'WATCH' ELSE 'NO_SIGNAL' END"""

_INTRADAY_COLUMNS = (
    "rsi", "macd", "macd_histogram", "rvol", "atr", "vwap_distance", "ema9_distance", "ema20_distance",
    "ema50_distance", "breakout_distance", "day_high_distance", "previous_day_high_distance",
    "volume_acceleration", "price_acceleration",
)


def f07_intraday_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.intraday_rows(spark, folder)
    return rows.select("symbol", "ts", "rvol_method", *[r(c, 4).alias(c) for c in _INTRADAY_COLUMNS])


def f08_intraday_score(spark: SparkSession, folder: str) -> DataFrame:
    return data.snapshot_rows(spark, folder).select("symbol", "ts", "radar_score")


def f09_early_momentum(spark: SparkSession, folder: str) -> DataFrame:
    return data.snapshot_rows(spark, folder).select("symbol", "ts", "early_momentum_score")


def f10_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    newest = feat.last_bar(data.snapshot_rows(spark, folder))
    return newest.select(
        "signal_id", "symbol", "ts", "timeframe", r("price").alias("price"), "radar_score", "classification",
        "early_momentum_score", "rvol_method", "provider_latency_seconds",
    )


QUERIES |= {
    "f07_intraday_features": f07_intraday_features, "f08_intraday_score": f08_intraday_score,
    "f09_early_momentum": f09_early_momentum, "f10_snapshot": f10_snapshot,
}
ORACLES["f07_intraday_features"] = INTRADAY + (
    "SELECT symbol, ts, rvol_method, " + ", ".join(f"round({c}, 4) AS {c}" for c in _INTRADAY_COLUMNS) + " FROM ifeat")
ORACLES["f08_intraday_score"] = INTRADAY + "SELECT symbol, ts, radar_score FROM snap"
ORACLES["f09_early_momentum"] = INTRADAY + "SELECT symbol, ts, early_momentum_score FROM snap"
ORACLES["f10_snapshot"] = INTRADAY + f"""
SELECT signal_id, symbol, ts, '15m' AS timeframe, round(price, 6) AS price, radar_score, {CLASS_CASE} AS classification,
  early_momentum_score, rvol_method, 900.0 AS provider_latency_seconds
FROM snap QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"""


# --- text, buckets, alerts ------------------------------------------------------------------

# The driver's prose is not Turkish; these phrases occur in it and show the ordered first match.
DEMO_PHRASES = {"tion": "suffix", "the": "article", "der": "german", "los": "spanish", "eau": "french"}


def f11_classify_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    return docs.select(
        "doc_id", scoring.classify_text(F.col("text")).alias("category"),
        scoring.classify_text(F.col("text"), DEMO_PHRASES).alias("demo_category"),
    )


def _case(phrases: dict[str, str]) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower(text), '{p}') THEN '{c}'" for p, c in phrases.items()) + " ELSE 'other' END"


def f12_buckets(spark: SparkSession, folder: str) -> DataFrame:
    snaps = data.snapshot_rows(spark, folder)
    return snaps.groupBy(
        scoring.score_bucket(F.col("radar_score")).alias("score_bucket"),
        scoring.rvol_bucket(F.col("rvol")).alias("rvol_bucket"),
        scoring.rvol_accuracy_bucket(F.col("rvol")).alias("rvol_accuracy"),
        scoring.momentum_bucket(F.col("early_momentum_score")).alias("momentum_bucket"),
    ).agg(F.count(F.lit(1)).alias("signals"))


def f13_sample_maturity(spark: SparkSession, folder: str) -> DataFrame:
    per_user = tables.table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))
    return per_user.select("user_id", "samples", scoring.sample_maturity(F.col("samples")).alias("maturity"))


def f14_alert_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    """Each snapshot judged 30 minutes after the newest bar of all."""
    snaps = data.snapshot_rows(spark, folder)
    newest = snaps.agg((F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("now"))
    judged = snaps.crossJoin(F.broadcast(newest))
    reason = scoring.alert_reason(F.col("now"), 3 * 24 * 60, quality.in_session(F.col("ts")))
    return judged.select("symbol", "ts", reason.alias("reason"))


SHADOW_STATUS = "UNCALIBRATED"


def f15_alert_text(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of strong candidates half an hour after the newest bar; the ratio is unknown for the strongest."""
    snaps = data.snapshot_rows(spark, folder)
    newest = snaps.agg((F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("now"))
    strong = snaps.filter(F.col("radar_score") >= 70).crossJoin(F.broadcast(newest))
    strong = strong.withColumn("risk_reward", F.when(F.col("radar_score") < 80, F.col("rvol") / 8))
    return strong.select("signal_id", scoring.alert_text(F.col("now"), SHADOW_STATUS).alias("message"))


def f15_research_text(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of all snapshots, with shadow probabilities for the scores from 60 on."""
    snaps = data.snapshot_rows(spark, folder)
    shadow = F.when(F.col("radar_score") >= 60, F.create_map(F.lit("entry"), F.col("radar_score") / 128, F.lit("stop"), 1 - F.col("radar_score") / 128))
    return snaps.select("signal_id", scoring.research_text(shadow).alias("message"))


QUERIES |= {
    "f11_classify_text": f11_classify_text, "f12_buckets": f12_buckets,
    "f13_sample_maturity": f13_sample_maturity, "f14_alert_eligibility": f14_alert_eligibility,
    "f15_alert_text": f15_alert_text, "f15_research_text": f15_research_text,
}
ORACLES["f11_classify_text"] = (
    f"SELECT doc_id, {_case(scoring.PHRASES)} AS category, {_case(DEMO_PHRASES)} AS demo_category FROM documents")
ORACLES["f12_buckets"] = INTRADAY + """
SELECT CASE WHEN radar_score >= 90 THEN '90+' WHEN radar_score >= 80 THEN '80-89' ELSE '70-79' END AS score_bucket,
  CASE WHEN rvol < 1 THEN '<1' WHEN rvol < 2 THEN '1-2' WHEN rvol < 3 THEN '2-3' WHEN rvol < 5 THEN '3-5' ELSE '5+' END AS rvol_bucket,
  CASE WHEN rvol >= 2 THEN '2+' WHEN rvol >= 1.5 THEN '1.5-2' ELSE '<1.5' END AS rvol_accuracy,
  CASE WHEN early_momentum_score < 60 THEN '<60' WHEN early_momentum_score < 80 THEN '60-79'
       WHEN early_momentum_score < 90 THEN '80-89' ELSE '90+' END AS momentum_bucket, count(*) AS signals
FROM snap GROUP BY 1, 2, 3, 4"""
ORACLES["f13_sample_maturity"] = """
SELECT user_id, count(*) AS samples, CASE WHEN count(*) < 50 THEN 'INSUFFICIENT_DATA' WHEN count(*) < 200 THEN 'EXPERIMENTAL'
  WHEN count(*) < 500 THEN 'EARLY' WHEN count(*) < 2000 THEN 'MODERATE_SAMPLE' ELSE 'MATURE_SAMPLE' END AS maturity
FROM events GROUP BY 1"""
ORACLES["f14_alert_eligibility"] = INTRADAY + f"""
SELECT symbol, ts, CASE WHEN NOT (isodow(ts + INTERVAL 3 HOUR) <= 5 AND strftime(ts + INTERVAL 3 HOUR, '%H:%M:%S') BETWEEN '10:00:00' AND '18:10:00')
    THEN 'ALERT_SUPPRESSED_MARKET_CLOSED'
  WHEN (SELECT max(ts) FROM snap) + INTERVAL 30 MINUTE - ts > INTERVAL 3 DAY THEN 'ALERT_SUPPRESSED_STALE_DATA'
  WHEN radar_score < 80 THEN 'ALERT_SUPPRESSED_CLASS' END AS reason
FROM snap"""
ORACLES["f15_alert_text"] = INTRADAY + f"""
SELECT signal_id, array_to_string([CASE WHEN radar_score >= 90 THEN '{scoring.ALERT_TITLES[0]}' ELSE '{scoring.ALERT_TITLES[1]}' END, '', symbol,
  'Radar: ' || radar_score || '/100', 'Fiyat: ' || format('{{:g}}', price), '15m RVOL: ' || format('{{:.2f}}', rvol) || 'x', 'Early Momentum: ' || early_momentum_score,
  'Risk/Getiri: ' || CASE WHEN radar_score < 80 THEN '1:' || format('{{:.1f}}', rvol / 8) ELSE '{scoring.NO_RATIO}' END, '',
  'Veri zamanı: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00'), 'Veri yaşı: ' || format('{{:.0f}}', date_diff('second', ts, (SELECT max(ts) FROM snap) + INTERVAL 30 MINUTE) / 60.0) || ' dk',
  '', 'Shadow:', '{SHADOW_STATUS}', '', '{scoring.PAPER_ONLY}', '{scoring.ALERT_DISCLAIMER}'], chr(10)) AS message
FROM snap WHERE radar_score >= 70"""
ORACLES["f15_research_text"] = INTRADAY + f"""
SELECT signal_id, array_to_string(list_concat(['{scoring.RESEARCH_TITLE}', '', symbol, 'Radar: ' || radar_score, '15m RVOL: ' || format('{{:.2f}}', rvol) || 'x',
  'Early momentum: ' || early_momentum_score, 'Data timestamp: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00'), 'Data latency: 15.0m'],
  CASE WHEN radar_score >= 60 THEN ['', 'Shadow ML:', 'entry: ' || format('{{:.1f}}', radar_score / 128.0::DOUBLE * 100) || '%', 'stop: ' || format('{{:.1f}}', (1 - radar_score / 128.0::DOUBLE) * 100) || '%', 'Mode: SHADOW'] ELSE [] END,
  ['', '{scoring.PAPER_ONLY}', '{scoring.DISCLAIMER}']), chr(10)) AS message FROM snap"""
