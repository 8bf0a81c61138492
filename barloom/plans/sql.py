"""Shared DuckDB fragments for the oracle queries: common table expressions by name."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_type AS symbol, user_id, event_id, ts, 100 + value / 50 AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"""


def _event_bars(name: str, bucket: str, symbol: str = "symbol") -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, time_bucket(INTERVAL '{bucket}', ts) AS ts,
         arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2)"""


M15 = TICKS + ", " + _event_bars("bars", "15 minutes")
HOUR = TICKS + ", " + _event_bars("bars", "1 hour")
USER_HOUR = TICKS + ", " + _event_bars("bars", "1 hour", "CAST(user_id AS VARCHAR)")

_DAY_AGG = """SELECT {symbol} AS symbol, l_shipdate AS ts,
         arg_min(price, (l_orderkey, l_linenumber, l_partkey)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (l_orderkey, l_linenumber, l_partkey)) AS close,
         sum(l_quantity) AS volume
  FROM lines GROUP BY 1, 2"""
LINES = """lines AS (
  SELECT lineitem.*, r_name, n_name, 100 + l_extendedprice / l_quantity / 1000 AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
DAY = LINES + ", bars AS (" + _DAY_AGG.format(symbol="r_name") + ")"
MARKET = "market AS (" + _DAY_AGG.format(symbol="'MARKET'") + ")"

NUMBERED = "num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM bars)"

# Lagged columns used by several queries.
STEPS = """steps AS (
  SELECT *, lag(close) OVER w AS prev_close,
         greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
         close / nullif(lag(close) OVER w, 0) - 1 AS ret
  FROM num WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def recursion(source: str = "num") -> str:
    """All recursive means by their definition: one recursion step per bar."""
    spans = (9, 12, 20, 26, 50, 200)
    seeds = ", ".join(f"close AS e{p}" for p in spans)
    step = ", ".join(f"r.e{p} + (b.close - r.e{p}) * 2 / {p + 1}" for p in spans)
    line = "(r.e12 + (b.close - r.e12) * 2 / 13) - (r.e26 + (b.close - r.e26) * 2 / 27)"
    return f"""rec AS (
  SELECT symbol, n, ts, open, high, low, close, volume, {seeds},
         CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, high - low AS atr_raw,
         CAST(NULL AS DOUBLE) AS sig
  FROM {source} WHERE n = 0
  UNION ALL
  SELECT b.symbol, b.n, b.ts, b.open, b.high, b.low, b.close, b.volume, {step},
         CASE WHEN b.n = 1 THEN greatest(b.close - r.close, 0) ELSE r.gain + (greatest(b.close - r.close, 0) - r.gain) / 14 END,
         CASE WHEN b.n = 1 THEN greatest(r.close - b.close, 0) ELSE r.loss + (greatest(r.close - b.close, 0) - r.loss) / 14 END,
         r.atr_raw + (greatest(b.high - b.low, abs(b.high - r.close), abs(b.low - r.close)) - r.atr_raw) / 14,
         CASE WHEN b.n = 25 THEN {line} WHEN b.n > 25 THEN r.sig + ({line} - r.sig) * 2 / 10 END
  FROM rec r JOIN {source} b ON b.symbol = r.symbol AND b.n = r.n + 1),
ind AS MATERIALIZED (
  SELECT symbol, n, ts, open, high, low, close, volume,
         CASE WHEN n >= 8 THEN e9 END AS ema9, CASE WHEN n >= 19 THEN e20 END AS ema20,
         CASE WHEN n >= 49 THEN e50 END AS ema50, CASE WHEN n >= 199 THEN e200 END AS ema200,
         e20 AS ema20_raw,
         CASE WHEN n >= 25 THEN e12 - e26 END AS macd, CASE WHEN n >= 33 THEN sig END AS macd_signal,
         CASE WHEN n >= 33 THEN e12 - e26 - sig END AS macd_histogram,
         CASE WHEN n >= 13 THEN atr_raw END AS atr,
         CASE WHEN n >= 14 THEN CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss = 0 THEN 50
              ELSE 100 - 100 / (1 + gain / loss) END END AS rsi
  FROM rec)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
