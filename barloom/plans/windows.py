"""Time-series queries: one per indicator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions import recursive as rec
from barloom.functions import sessions
from barloom.functions.bars import arrival_order, build_bars
from barloom.operators.features import add_levels
from barloom.plans import sql
from barloom.plans.common import day_series, m15_series, r, series
from barloom.series import Series
from barloom.sources import tables
from barloom.staging import staged

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _window(name: str, columns: Callable[[Series], dict[str, Column]], oracle: dict[str, str],
            digits: int = 6, halo: int = 32) -> None:
    """Register a bounded window indicator on the 15-minute bars."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = m15_series(spark, folder, halo)
        s = s.add({"ret": ind.pct_change(s, F.col("close"))})
        cols = columns(s)
        return s.add(cols).rows().select("symbol", "ts", *[r(c, digits).alias(c) for c in cols])

    picks = ", ".join(f"round({e}, {digits}) AS {c}" for c, e in oracle.items())
    QUERIES[name] = run
    ORACLES[name] = (
        sql.with_(sql.M15, sql.NUMBERED, sql.STEPS)
        + f"SELECT symbol, ts, {picks} FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    )


def _rows(n: int, offset: int = 0) -> str:
    end = "CURRENT ROW" if offset == 0 else f"{offset} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + offset} PRECEDING AND {end})"


_window("ts01_sma", lambda s: {"sma20": ind.sma(s, F.col("close"), 20), "sma5": ind.sma(s, F.col("close"), 5)},
        {"sma20": f"CASE WHEN n >= 19 THEN avg(close) {_rows(20)} END",
         "sma5": f"CASE WHEN n >= 4 THEN avg(close) {_rows(5)} END"})
_window("ts05_true_range", lambda s: {"true_range": ind.true_range(s)}, {"true_range": "tr"})
_window("ts07_bollinger", lambda s: ind.bollinger(s, F.col("close")),
        {"bb_lower": f"CASE WHEN n >= 19 THEN avg(close) {_rows(20)} - 2 * stddev_pop(close) {_rows(20)} END",
         "bb_middle": f"CASE WHEN n >= 19 THEN avg(close) {_rows(20)} END",
         "bb_upper": f"CASE WHEN n >= 19 THEN avg(close) {_rows(20)} + 2 * stddev_pop(close) {_rows(20)} END"})
_window("ts09_relative_volume", lambda s: {"rvol": ind.relative_volume(s, F.col("volume"))},
        {"rvol": f"CASE WHEN n >= 20 THEN volume / nullif(avg(volume) {_rows(20, 1)}, 0) END"})
_window("ts10_roc", lambda s: {"roc": ind.roc(s, F.col("close"))},
        {"roc": "(close / lag(close, 10) OVER w - 1) * 100"})
_window("ts11_rolling_volatility", lambda s: {"volatility": ind.rolling_volatility(s, F.col("ret"))},
        {"volatility": f"CASE WHEN n >= 20 THEN stddev_pop(ret) {_rows(20)} END"})
_window("ts12_13_rolling_extremes",
        lambda s: {"highest_high": ind.rolling_max(s, F.col("high"), 20),
                   "lowest_low": ind.rolling_min(s, F.col("low"), 20)},
        {"highest_high": f"CASE WHEN n >= 19 THEN max(high) {_rows(20)} END",
         "lowest_low": f"CASE WHEN n >= 19 THEN min(low) {_rows(20)} END"})
_window("ts15_prior_extremes",
        lambda s: {"prior_high": ind.rolling_max(s, F.col("high"), 20, 1),
                   "prior_low": ind.rolling_min(s, F.col("low"), 10, 1)},
        {"prior_high": f"CASE WHEN n >= 20 THEN max(high) {_rows(20, 1)} END",
         "prior_low": f"CASE WHEN n >= 10 THEN min(low) {_rows(10, 1)} END"})
_window("ts17_close_quality", lambda s: {"close_quality": ind.close_quality()},
        {"close_quality": "(close - low) / greatest(high - low, 1e-9)"})
_window("ts22_acceleration",
        lambda s: {"volume_acceleration": ind.pct_change(s, F.col("volume")),
                   "price_acceleration": ind.diff(s, F.col("ret"))},
        {"volume_acceleration": "volume / nullif(lag(volume) OVER w, 0) - 1",
         "price_acceleration": "ret - lag(ret) OVER w"})


# --- recursive means on the daily bars ------------------------------------------------------

_RECURSIVE = sql.with_(sql.DAY, sql.NUMBERED, sql.recursion(), recursive=True)


def _recursive(name: str, picks: dict[str, str], build: Callable[[Series], Series] | None = None) -> None:
    """Register picks (output column -> oracle expression over ``ind``) of the level table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        if build is None:
            rows = staged("daily_levels", spark, folder, lambda: add_levels(day_series(spark, folder)).rows())
        else:
            rows = build(add_levels(day_series(spark, folder))).rows()
        return rows.select("symbol", "ts", *[r(c, 4).alias(c) for c in picks])

    QUERIES[name] = run
    chosen = ", ".join(f"round({e}, 4) AS {c}" for c, e in picks.items())
    ORACLES[name] = _RECURSIVE + (
        f"SELECT symbol, ts, {chosen} FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    )


_recursive("ts02_ema", {c: c for c in ("ema9", "ema20", "ema50", "ema200")})
_recursive("ts03_rsi", {"rsi": "rsi"})
_recursive("ts04_macd", {c: c for c in ("macd", "macd_signal", "macd_histogram")})
_recursive("ts06_atr", {"atr": "atr"})
_recursive("ts14_distance_from_ema",
           {f"ema{p}_distance": f"(close / ema{p} - 1) * 100" for p in (9, 20, 50)},
           lambda s: s.add({f"ema{p}_distance": ind.distance_percent(F.col("close"), F.col(f"ema{p}"))
                            for p in (9, 20, 50)}))
_recursive("ts16_slopes",
           {"ema20_slope": "ema20 - lag(ema20, 5) OVER w", "ema50_slope": "ema50 - lag(ema50, 5) OVER w",
            "macd_slope": "macd - lag(macd, 3) OVER w",
            "high_change": "high - lag(high, 5) OVER w", "low_change": "low - lag(low, 5) OVER w"},
           lambda s: s.add({"ema20_slope": ind.diff(s, F.col("ema20"), 5),
                            "ema50_slope": ind.diff(s, F.col("ema50"), 5),
                            "macd_slope": ind.diff(s, F.col("macd"), 3),
                            "high_change": ind.diff(s, F.col("high"), 5),
                            "low_change": ind.diff(s, F.col("low"), 5)}))


def ts08_vwap(spark: SparkSession, folder: str) -> DataFrame:
    s = day_series(spark, folder)
    s = s.add({"traded": ind.typical_price() * F.col("volume")})
    s = rec.add_means(s, [], totals=["traded", "volume"])
    vwap = F.col("cum_traded") / F.nullif("cum_volume", F.lit(0.0))
    return s.rows().select("symbol", "ts", r(vwap).alias("vwap"))


QUERIES["ts08_vwap"] = ts08_vwap
ORACLES["ts08_vwap"] = sql.with_(sql.DAY) + """
SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""


# --- sessions and slots ---------------------------------------------------------------------

def ts18_slot_relative_volume(spark: SparkSession, folder: str) -> DataFrame:
    s = series(tables.hour_bars(spark, folder), "60m")
    frame = s.last(20, offset=1)
    mean = F.when(F.count("volume").over(frame) >= 5, F.avg("volume").over(frame))
    bars = s.add({"rolling_rvol": F.col("volume") / F.nullif(mean, F.lit(0.0))}).rows()
    out = sessions.add_slot_relative_volume(bars, fallback="rolling_rvol")
    return out.select("symbol", "ts", r("rvol").alias("rvol"), "rvol_method")


QUERIES["ts18_slot_relative_volume"] = ts18_slot_relative_volume
ORACLES["ts18_slot_relative_volume"] = sql.with_(sql.HOUR) + """,
slots AS (
  SELECT *, CASE WHEN count(*) OVER s20 = 20 THEN avg(volume) OVER s20 END AS slot_mean,
         CASE WHEN count(*) OVER r20 >= 5 THEN avg(volume) OVER r20 END AS roll_mean
  FROM bars
  WINDOW s20 AS (PARTITION BY symbol, strftime(ts, '%H:%M') ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         r20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
known AS (SELECT symbol, bool_or(slot_mean IS NOT NULL) AS k FROM slots GROUP BY 1)
SELECT symbol, ts, round(volume / nullif(CASE WHEN k THEN slot_mean ELSE roll_mean END, 0), 6) AS rvol,
       CASE WHEN k THEN 'HISTORICAL_BAR_SLOT' ELSE 'ROLLING_FALLBACK' END AS rvol_method
FROM slots JOIN known USING (symbol)"""


def ts19_session_vwap(spark: SparkSession, folder: str) -> DataFrame:
    out = sessions.add_session_columns(tables.m15_bars(spark, folder))
    return out.select("symbol", "ts", r("session_vwap").alias("session_vwap"))


def ts20_session_high(spark: SparkSession, folder: str) -> DataFrame:
    out = sessions.add_session_columns(tables.m15_bars(spark, folder))
    return out.select("symbol", "ts", r("session_high").alias("session_high"))


def ts21_previous_session_high(spark: SparkSession, folder: str) -> DataFrame:
    out = sessions.add_previous_session_high(tables.m15_bars(spark, folder))
    return out.select("symbol", "ts", r("previous_session_high").alias("previous_session_high"))


QUERIES |= {
    "ts19_session_vwap": ts19_session_vwap,
    "ts20_session_high": ts20_session_high,
    "ts21_previous_session_high": ts21_previous_session_high,
}
_DAYWISE = "WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)"
ORACLES["ts19_session_vwap"] = sql.with_(sql.M15) + f"""
SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS session_vwap
FROM bars {_DAYWISE}"""
ORACLES["ts20_session_high"] = sql.with_(sql.M15) + f"""
SELECT symbol, ts, round(max(high) OVER w, 6) AS session_high FROM bars {_DAYWISE}"""
ORACLES["ts21_previous_session_high"] = sql.with_(sql.M15) + """,
days AS (SELECT symbol, CAST(ts AS DATE) AS d, max(high) AS h FROM bars GROUP BY 1, 2),
prior AS (SELECT symbol, d, lag(h) OVER (PARTITION BY symbol ORDER BY d) AS p FROM days)
SELECT bars.symbol, ts, round(p, 6) AS previous_session_high
FROM bars JOIN prior ON bars.symbol = prior.symbol AND CAST(ts AS DATE) = d"""


def ts23_lifecycle_context(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.operators.lifecycle import context_columns

    out = context_columns(m15_series(spark, folder)).rows()
    return out.select(
        "symbol", "ts", r("ctx_vwap", 4).alias("vwap"), r("ctx_ema20", 4).alias("ema20"),
        r("ctx_momentum").alias("momentum"), r("ctx_rvol").alias("rvol"), r("ctx_atr").alias("atr"),
    )


QUERIES["ts23_lifecycle_context"] = ts23_lifecycle_context
ORACLES["ts23_lifecycle_context"] = sql.with_(sql.M15, sql.NUMBERED, sql.STEPS, """ema AS (
  SELECT symbol, n, close AS e FROM num WHERE n = 0
  UNION ALL
  SELECT b.symbol, b.n, r.e + (b.close - r.e) * 2 / 21 FROM ema r JOIN num b ON b.symbol = r.symbol AND b.n = r.n + 1)""",
  recursive=True) + f"""
SELECT s.symbol, s.ts, round(v / nullif(q, 0), 4) AS vwap, round(e, 4) AS ema20, round(momentum, 6) AS momentum,
       round(rvol, 6) AS rvol, round(atr, 6) AS atr
FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER w AS v, sum(volume) OVER w AS q,
             close / lag(close, 3) OVER w - 1 AS momentum,
             CASE WHEN n >= 8 THEN volume / nullif(avg(volume) {_rows(8, 1)}, 0) END AS rvol,
             avg(tr) {_rows(14)} AS atr
      FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY ts)) s
JOIN ema ON ema.symbol = s.symbol AND ema.n = s.n"""


def ts24_relative_strength(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.operators.features import add_benchmark_return

    s = day_series(spark, folder)
    s = s.add({"ret20": ind.pct_change(s, F.col("close"), 20)})
    market = series(tables.market_day_bars(spark, folder), "1d")
    market = market.add({"market_ret20": ind.pct_change(market, F.col("close"), 20)}).rows()
    out = add_benchmark_return(s.rows(), market)
    return out.select("symbol", "ts", r("relative_strength").alias("relative_strength"))


QUERIES["ts24_relative_strength"] = ts24_relative_strength
ORACLES["ts24_relative_strength"] = sql.with_(sql.DAY, sql.MARKET) + """
SELECT b.symbol, b.ts, round((b.r - m.r) * 100, 6) AS relative_strength
FROM (SELECT symbol, ts, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) b
JOIN (SELECT ts, close / lag(close, 20) OVER (ORDER BY ts) - 1 AS r FROM market) m ON b.ts = m.ts
WHERE m.r IS NOT NULL"""


# --- bars -----------------------------------------------------------------------------------

def _bars(ticks: Callable, timeframe: str) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build_bars(ticks(spark, folder), timeframe)
    return run


_BAR_COLUMNS = "SELECT symbol, ts, open, high, low, close, volume FROM bars"
for _name, _load, _cte in (
    ("st01_bars_15m", (tables.event_ticks, "15m"), sql.M15), ("st01_bars_60m", (tables.event_ticks, "60m"), sql.HOUR),
    ("st01_bars_60m_by_user", (lambda s, f: tables.event_ticks(s, f, symbol="user_id"), "60m"), sql.USER_HOUR),
    ("st01_bars_1d", (tables.line_ticks, "1d"), sql.DAY),
):
    QUERIES[_name] = _bars(*_load)
    ORACLES[_name] = sql.with_(_cte) + _BAR_COLUMNS


def st01_large_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Many ticks at one instant whose keys differ beyond 26 bits: the whole key orders them."""
    ticks = tables.table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("event_id") % 7 * F.lit(2**40) + F.col("event_id") * F.lit(2**26)).alias("key"),
        (100 + F.col("value") / 50).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )
    return build_bars(ticks.withColumn("seq", arrival_order(F.col("ts"), F.col("key"))), "60m")


QUERIES["st01_bars_large_keys"] = st01_large_keys
ORACLES["st01_bars_large_keys"] = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(100 + value / 50, k) AS open, max(100 + value / 50) AS high,
  min(100 + value / 50) AS low, arg_max(100 + value / 50, k) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
FROM (SELECT *, event_id % 7 * 1099511627776 + event_id * 67108864 AS k FROM events) GROUP BY 1, 2"""

SHORT_SPANS = (1, 2, 3)


def ts02_short(spark: SparkSession, folder: str) -> DataFrame:
    """Means of one row are the value itself; their digits are compared before any rounding."""
    s = day_series(spark, folder)
    means = [rec.span_mean(f"ema{p}", "close", p) for p in SHORT_SPANS] + [rec.wilder_mean(f"wilder{p}", "close", p) for p in (1, 2)]
    rows = rec.add_means(s, means).rows()
    return rows.select(
        "symbol", "ts", *[(F.col(m.name) == F.col("close")).alias(f"{m.name}_is_close") for m in means if m.periods == 1],
        *[r(m.name, 4).alias(m.name) for m in means if m.periods > 1],
    )


_SHORT = {f"ema{p}": (2 / (p + 1), p) for p in SHORT_SPANS if p > 1} | {"wilder2": (0.5, 2)}
QUERIES["ts02_ema_short_spans"] = ts02_short
ORACLES["ts02_ema_short_spans"] = sql.with_(sql.DAY, sql.NUMBERED, f"""short AS (
  SELECT symbol, n, ts, {", ".join(f"close AS {c}" for c in _SHORT)} FROM num WHERE n = 0 UNION ALL
  SELECT b.symbol, b.n, b.ts, {", ".join(f"q.{c} + (b.close - q.{c}) * {a!r}::DOUBLE" for c, (a, _) in _SHORT.items())}
  FROM short q JOIN num b ON b.symbol = q.symbol AND b.n = q.n + 1)""", recursive=True) + "SELECT symbol, ts, true AS ema1_is_close, true AS wilder1_is_close, " + ", ".join(
    f"CASE WHEN n >= {p - 1} THEN round({c}, 4) END AS {c}" for c, (_, p) in _SHORT.items()) + " FROM short"
