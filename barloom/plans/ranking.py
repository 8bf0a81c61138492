"""Ordering, paging, set and time-join queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import joins, labels, ranking
from barloom.plans import datasets as data
from barloom.plans import sql
from barloom.plans.analytics import RECORDS, record_rows
from barloom.plans.common import r
from barloom.plans.features import INTRADAY, SCORES
from barloom.plans.trades import TRADES, trade_rows
from barloom.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("o01_top_candidates", SCORES + "SELECT symbol, ts, score FROM scored WHERE score >= 70 ORDER BY score DESC, symbol, ts LIMIT 10")
def o01(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.daily_score_rows(spark, folder).select("symbol", "ts", "score")
    return ranking.top_candidates(rows, ties=("ts",))


@query("o02_newest_per_symbol", """
SELECT upper(trim(s)) AS symbol, arg_max(radar_score, (ts, -event_id)) AS radar_score, max(ts) AS ts FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN ' ' || event_type ELSE upper(event_type) END AS s, floor(value)::BIGINT AS radar_score, date_trunc('hour', ts) AS ts, event_id FROM events) GROUP BY 1""")
def o02(spark: SparkSession, folder: str) -> DataFrame:
    """Events as candidate rows with untidy symbols and hours as times."""
    symbol = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.upper("event_type"))
    rows = tables.table(spark, folder, "events").select(
        symbol.alias("symbol"), F.floor("value").cast("long").alias("radar_score"), F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    return ranking.newest_per_symbol(rows).select("symbol", "radar_score", "ts")


@query("o03_latest_bars", sql.with_(sql.M15) + "SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120")
def o03(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.latest_bars(tables.m15_bars(spark, folder), 120).select("symbol", "ts", "close")


@query("o04_order_entries", SCORES + """
SELECT symbol, ts AS signal_time, score, round((target_2 - close) / (close - stop), 6) AS risk_reward FROM scored WHERE score >= 60""")
def o04(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranking.order_entries(data.orders(spark, folder, 60))
    return rows.select("symbol", "signal_time", "score", r("risk_reward").alias("risk_reward"))


@query("o05_record_page", RECORDS + """
SELECT signal_id, ts, (SELECT count(*) FROM recs WHERE symbol = 'click' AND score_bucket = '70-79') AS total FROM recs WHERE symbol = 'click' AND score_bucket = '70-79'
ORDER BY ts DESC, signal_id LIMIT 25 OFFSET 25""")
def o05(spark: SparkSession, folder: str) -> DataFrame:
    rows = record_rows(spark, folder).filter((F.col("symbol") == "click") & (F.col("score_bucket") == "70-79"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return ranking.page(rows, [F.desc("ts"), F.col("signal_id")], 2, 25).select("signal_id", "ts").crossJoin(F.broadcast(total))  # one row


@query("o05_records_by_day_and_status", RECORDS + """
SELECT signal_id, lifecycle, result_classification FROM recs WHERE CAST(ts + INTERVAL 3 HOUR AS DATE) = DATE '2024-01-17' AND (lifecycle = 'STOPPED' OR result_classification = 'STOPPED')""")
def o05_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Exchange-local day and a status that may be a labelling state or an audit result."""
    start = F.to_utc_timestamp(F.lit("2024-01-17").cast("timestamp"), "Europe/Istanbul")
    inside = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY"))
    status = (F.col("lifecycle") == "STOPPED") | (F.col("result_classification") == "STOPPED")
    return record_rows(spark, folder).filter(inside & status).select("signal_id", "lifecycle", "result_classification")


@query("o06_signal_history", INTRADAY + "SELECT signal_id, symbol, ts, radar_score FROM snap ORDER BY ts DESC, symbol LIMIT 200")
def o06(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.history(data.snapshot_rows(spark, folder), 200).select("signal_id", "symbol", "ts", "radar_score")


@query("o07_candidate_search", RECORDS + "SELECT signal_id, symbol, radar_score FROM recs WHERE contains(upper(symbol), 'I') AND classification = 'CANDIDATE'")
def o07(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(record_rows(spark, folder), text="i", classification="CANDIDATE").select("signal_id", "symbol", "radar_score")


_TWO = sql.with_(sql.TICKS, sql._event_bars("bars", "15 minutes"), sql._event_bars("hours", "1 hour"))


@query("o08_timeline_union", _TWO + "SELECT ts FROM bars UNION SELECT ts FROM hours")
def o08(spark: SparkSession, folder: str) -> DataFrame:
    return tables.m15_bars(spark, folder).select("ts").union(tables.hour_bars(spark, folder).select("ts")).distinct()


@query("o09_fresh_and_active", """
SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'""")
def o09(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    fresh = events.filter(F.col("ts").cast("timestamp") >= F.lit("2024-01-30").cast("timestamp")).select("user_id")
    return fresh.intersect(events.filter(F.col("event_type") == "purchase").select("user_id"))


@query("o10_no_longer_listed", """
SELECT user_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR
EXCEPT SELECT user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def o10(spark: SparkSession, folder: str) -> DataFrame:
    """Users without an event in the last twelve hours."""
    events = tables.table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    cut = F.lit(events.agg(F.max("t")).first()[0]) - F.expr("INTERVAL 12 HOURS")
    return events.filter(F.col("t") < cut).select("user_id").subtract(events.filter(F.col("t") >= cut).select("user_id"))


@query("o11_distinct_symbols", "SELECT DISTINCT upper(trim(o_orderpriority)) AS symbol FROM orders ORDER BY 1")
def o11(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "orders").select(F.upper(F.trim("o_orderpriority")).alias("symbol")).distinct().orderBy("symbol")


@query("o12_failures", """
WITH us AS (SELECT user_id::VARCHAR AS symbol, arg_max(event_type, (ts, event_id)) AS lt FROM events GROUP BY 1)
SELECT symbol, CASE lt WHEN 'purchase' THEN 'UNKNOWN' WHEN 'error' THEN 'PROVIDER_UNAVAILABLE' ELSE 'TEMPORARILY_DEGRADED' END AS provider_status FROM us WHERE lt IN ('purchase', 'error', 'view') ORDER BY 1""")
def o12(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.plans.ingestion import _recorded

    rows = _recorded(spark, folder).filter(F.col("active") & (F.col("provider_status") != "AVAILABLE"))
    return rows.select("symbol", "provider_status").orderBy("symbol")


@query("o13_signals_of_symbol", INTRADAY + "SELECT signal_id, radar_score FROM snap WHERE symbol = 'view' AND radar_score >= 60")
def o13(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.snapshot_rows(spark, folder)
    return rows.filter((F.col("symbol") == "view") & (F.col("classification") != "NO_SIGNAL")).select("signal_id", "radar_score")


@query("o14_quotes", sql.with_(sql.USER_HOUR) + "SELECT symbol, arg_max(close, ts) AS price, max(ts) AS ts FROM bars GROUP BY 1")
def o14(spark: SparkSession, folder: str) -> DataFrame:
    return tables.user_hour_bars(spark, folder).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.max("ts").alias("ts"))


# --- joins ----------------------------------------------------------------------------------

@query("j04_active_symbol_bars", sql.with_(sql.USER_HOUR) + "SELECT symbol, ts, close FROM bars WHERE symbol IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'signup' AND value > 150)")
def j04(spark: SparkSession, folder: str) -> DataFrame:
    active = tables.table(spark, folder, "events").filter((F.col("event_type") == "signup") & (F.col("value") > 150)).select(F.col("user_id").cast("string").alias("symbol"))
    return tables.user_hour_bars(spark, folder).join(active, "symbol", "left_semi").select("symbol", "ts", "close")


@query("j07_full_outer_merge", _TWO + """
SELECT coalesce(b.symbol, h.symbol) AS symbol, coalesce(b.ts, h.ts) AS ts, b.close AS fast_close, h.close AS slow_close, h.close IS NOT DISTINCT FROM b.close AS same FROM bars b FULL JOIN hours h ON h.symbol = b.symbol AND h.ts = b.ts""")
def j07(spark: SparkSession, folder: str) -> DataFrame:
    b = tables.m15_bars(spark, folder).select("symbol", "ts", F.col("close").alias("fast_close"))
    h = tables.hour_bars(spark, folder).select("symbol", "ts", F.col("close").alias("slow_close"))
    return b.join(h, ["symbol", "ts"], "full_outer").withColumn("same", F.col("slow_close").eqNullSafe(F.col("fast_close")))


@query("j08_as_of", _TWO + """
SELECT t.event_id, t.symbol, t.ts, h.close AS last_close, h.ts AS bar_ts FROM ticks t ASOF LEFT JOIN hours h ON h.symbol = t.symbol AND t.ts >= h.ts + INTERVAL 1 HOUR""")
def j08(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the close of the last hour that had ended before it."""
    events = tables.table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    hours = tables.hour_bars(spark, folder).select(
        "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("close").alias("last_close"), F.col("ts").alias("bar_ts"))
    out = joins.as_of(events, hours, ["symbol"], F.floor(F.unix_seconds("ts") / 86400), ["last_close", "bar_ts"], tie="event_id")
    return out.select("event_id", "symbol", "ts", "last_close", "bar_ts")


@query("j09_visible_benchmark", SCORES + """
SELECT s.symbol, s.ts, count(m.ts) AS visible_rows FROM (SELECT symbol, ts FROM scored WHERE score >= 70) s JOIN market m ON m.ts <= s.ts GROUP BY 1, 2""")
def j09(spark: SparkSession, folder: str) -> DataFrame:
    """How many benchmark rows each candidate may see: the position of the benchmark's last row up to then."""
    market = tables.market_day_bars(spark, folder).select(F.lit(1).alias("k"), "ts", (F.col("bar_no") + 1).alias("visible_rows"))
    picked = data.daily_score_rows(spark, folder).filter(F.col("score") >= 70).select(F.lit(1).alias("k"), "symbol", "ts", F.xxhash64("symbol").alias("tie"))
    seen = joins.as_of(picked, market, ["k"], F.year("ts"), ["visible_rows"], tie="tie")
    return seen.filter(F.col("visible_rows").isNotNull()).select("symbol", "ts", "visible_rows")


@query("j10_next_bars", INTRADAY + """
SELECT s.signal_id, b.n - s.n AS i, b.ts AS bar_ts, b.close FROM snap s JOIN num b ON b.symbol = s.symbol AND b.n > s.n AND b.n <= s.n + 3 WHERE s.radar_score >= 70""")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    signals = data.snapshot_rows(spark, folder).filter(F.col("radar_score") >= 70).select("signal_id", "symbol", "bar_no")
    return labels.attach_next(signals, tables.m15_bars(spark, folder), 3, ("signal_id",)).select("signal_id", "i", "bar_ts", "close")


@query("j11_open_positions", TRADES + """
SELECT b.ts, count(trade_id) AS open_positions FROM (SELECT DISTINCT ts FROM num WHERE symbol <> 'MARKET') b LEFT JOIN trades t ON t.entry_time <= b.ts AND (t.exit_time IS NULL OR t.exit_time > b.ts) GROUP BY 1""")
def j11(spark: SparkSession, folder: str) -> DataFrame:
    stamps = tables.day_bars(spark, folder).select("ts")
    return joins.open_counts(trade_rows(spark, folder), stamps, "entry_time", "exit_time", F.year("ts"))


@query("j12_cross_source", _TWO + """
SELECT b.symbol, b.ts, round(abs(b.open - h.open), 6) AS open_gap, h.high >= b.high AS covers FROM bars b JOIN hours h ON h.symbol = b.symbol AND h.ts = b.ts""")
def j12(spark: SparkSession, folder: str) -> DataFrame:
    b, h = tables.m15_bars(spark, folder).alias("b"), tables.hour_bars(spark, folder).alias("h")
    return b.join(h, ["symbol", "ts"]).select("symbol", "ts", r(F.abs(F.col("b.open") - F.col("h.open"))).alias("open_gap"), (F.col("h.high") >= F.col("b.high")).alias("covers"))


@query("j13_benchmark_regime", SCORES + "SELECT t.symbol, t.ts, reg.regime FROM trended t JOIN reg ON reg.ts = t.ts WHERE symbol <> 'MARKET'")
def j13(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.operators.signals import split_benchmark

    rows, market = split_benchmark(data.daily_feature_rows(spark, folder))
    return rows.join(market, "ts").select("symbol", "ts", "regime")


@query("a03_scan_coverage", INTRADAY + """
SELECT (SELECT count(DISTINCT symbol) FROM snap WHERE radar_score >= 80) AS scanned, count(DISTINCT symbol) AS active,
  round_even((SELECT count(DISTINCT symbol) FROM snap WHERE radar_score >= 80) * 100.0 / count(DISTINCT symbol), 2) AS scan_percent FROM bars""")
def a03(spark: SparkSession, folder: str) -> DataFrame:
    scanned = data.snapshot_rows(spark, folder).filter(F.col("radar_score") >= 80).agg(F.count_distinct("symbol").alias("scanned"))
    active = tables.m15_bars(spark, folder).agg(F.count_distinct("symbol").alias("active"))
    out = scanned.crossJoin(F.broadcast(active))  # one row each
    return out.withColumn("scan_percent", F.bround(F.col("scanned") / F.col("active") * 100, 2))
