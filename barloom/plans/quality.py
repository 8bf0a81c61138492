"""Quality gate queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ingest, quality
from barloom.plans import sql
from barloom.plans.common import r
from barloom.plans.raw import RAW_SQL, raw_bars
from barloom.quantiles import exact_quantiles
from barloom.series import blocked
from barloom.sources import tables, vendor

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
RAW = sql.with_(sql.M15, RAW_SQL)


def now() -> Column:
    """The moment the queries are asked at."""
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


NOW_SQL = "TIMESTAMP '2024-01-30 12:00:00'"


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


_SERIES_STATE = """prior AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(close) OVER w AS prev_close FROM {rows}
  WINDOW w AS (PARTITION BY symbol ORDER BY ingest_seq)),
dup AS (SELECT symbol, max(c) > 1 AS d FROM (SELECT symbol, ts, count(*) AS c FROM {rows} GROUP BY 1, 2) GROUP BY 1),
flags AS (SELECT symbol, d AS f1, coalesce(bool_or(ts < prev_ts), false) AS f2,
    bool_or(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS f3,
    bool_or(least(open, high, low, close) <= 0) AS f4, bool_or(volume < 0) AS f5,
    bool_or(coalesce(low > open, false) OR coalesce(open > high, false) OR coalesce(low > close, false) OR coalesce(close > high, false)) AS f6,
    bool_or(NOT regexp_full_match(symbol, '[A-Z0-9]{{2,12}}')) AS f7,
    coalesce(bool_or(abs(close / nullif(prev_close, 0) - 1) * 100 > 40), false) AS f9, max(ts) AS newest
  FROM prior JOIN dup USING (symbol) GROUP BY symbol, d),
state AS (SELECT *, f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f9::INT AS k,
    {now} - newest > INTERVAL 2 DAY AS old FROM flags)"""
_STATE_PICK = """SELECT symbol, CASE WHEN k > 0 THEN 'INVALID' WHEN old THEN 'STALE' ELSE 'OK' END AS status,
  CASE WHEN k > 0 THEN greatest(0.0, 100.0 - 20 * k) WHEN old THEN 70.0 ELSE 100.0 END AS quality_score, k AS failed_checks FROM state"""


def _state(rows: DataFrame, now) -> DataFrame:
    out = quality.validate_series(rows, now)
    failed = F.when(F.col("status") == "INVALID", F.size("errors")).otherwise(0)
    return out.select("symbol", "status", "quality_score", failed.alias("failed_checks"))


@query("v01_validate_raw_series", RAW + "," + _SERIES_STATE.format(rows="raw", now=NOW_SQL) + _STATE_PICK)
def v01_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _state(raw_bars(spark, folder), now())


@query("v01_validate_clean_series", sql.with_(
    sql.LINES, """bars0 AS (SELECT CASE WHEN r_name = 'MIDDLE EAST' THEN r_name ELSE upper(replace(r_name, ' ', '')) END AS symbol, l_shipdate AS ts,
      min(price) AS low, max(price) AS high, avg(price) AS close, avg(price) AS open, sum(l_quantity) AS volume FROM lines GROUP BY 1, 2),
    clean AS (SELECT *, epoch_ms(ts)::BIGINT AS ingest_seq FROM bars0)""",
    _SERIES_STATE.format(rows="clean", now="TIMESTAMP '2001-11-05'")) + _STATE_PICK)
def v01_clean(spark: SparkSession, folder: str) -> DataFrame:
    ticks = tables.line_ticks(spark, folder)
    bars = ticks.groupBy("symbol", F.date_trunc("DAY", "ts").alias("ts")).agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("close"),
        F.avg("price").alias("open"), F.sum("volume").alias("volume"),
    ).withColumn("ingest_seq", F.unix_millis("ts"))
    return _state(bars, F.lit("2001-11-05").cast("timestamp"))


@query("v01_missing_series", RAW + "," + _SERIES_STATE.format(rows="raw", now=NOW_SQL) + """
SELECT symbol, status FROM (""" + _STATE_PICK + """) UNION ALL
SELECT DISTINCT 'NO' || n_regionkey, 'MISSING' FROM nation""")
def v01_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols asked for without bars, beside those with bars."""
    absent = tables.table(spark, folder, "nation").select(F.concat(F.lit("NO"), F.col("n_regionkey").cast("string")).alias("symbol"))
    rows = raw_bars(spark, folder)
    return quality.validate_series(rows, now(), expected=absent.unionByName(rows.select("symbol"))).select("symbol", "status")


@query("v02_refused_histories", RAW + """,
p AS (SELECT symbol, bool_or(ts < p) AS unordered, bool_or(ts = p) AS duplicate
  FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS p FROM raw) GROUP BY 1)
SELECT symbol, CASE WHEN unordered THEN 'unordered historical data' WHEN duplicate THEN 'duplicate historical bar' ELSE 'unexpected symbol' END AS reason
FROM p WHERE symbol LIKE 'c%' OR unordered OR duplicate UNION ALL SELECT DISTINCT 'NO' || n_regionkey, 'malformed historical data' FROM nation""")
def v02_refused(spark: SparkSession, folder: str) -> DataFrame:
    absent = tables.table(spark, folder, "nation").select(F.concat(F.lit("NO"), F.col("n_regionkey").cast("string")).alias("symbol"))
    rows = raw_bars(spark, folder)
    return quality.refused_histories(rows, absent.unionByName(rows.select("symbol").filter(~F.col("symbol").startswith("c"))))


@query("v02_history_problems", RAW + """
SELECT symbol, false AS bad_timestamp, bool_or(ts < p) AS unordered, bool_or(ts = p) AS duplicate
FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS p FROM raw) GROUP BY 1""")
def v02(spark: SparkSession, folder: str) -> DataFrame:
    return quality.history_problems(raw_bars(spark, folder))


@query("v03_arrival_order", RAW + """
SELECT symbol, count(*) AS out_of_order FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS p FROM raw)
WHERE ts < p GROUP BY 1""")
def v03(spark: SparkSession, folder: str) -> DataFrame:
    late = quality.arrival_pairs(raw_bars(spark, folder)).filter(F.col("ts") < F.col("prev_ts"))
    return late.groupBy("symbol").agg(F.count(F.lit(1)).alias("out_of_order"))


_LATENCY = """lat AS (SELECT symbol, epoch_ms(received_at)::DOUBLE / 1000 - epoch_ms(ts)::DOUBLE / 1000 + volume AS v, ingest_seq, valid
  FROM (SELECT *, NOT (coalesce(least(open, high, low, close) <= 0, false) OR volume < 0 OR received_at < ts
    OR coalesce(low > open, false) OR coalesce(open > high, false) OR coalesce(low > close, false) OR coalesce(close > high, false)) AS valid FROM raw))"""


@query("v05_batch_quality_and_latency", RAW + "," + _LATENCY + """
SELECT symbol, count(*) AS received, count_if(valid) AS valid, round(count_if(valid) * 100.0 / count(*), 6) AS quality_percent,
  round(avg(v), 6) AS average, max(v) AS maximum,
  list_sort(list(v))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INT) + 1] AS p50,
  list_sort(list(v))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1] AS p95,
  list_sort(list(v))[CAST(round_even((count(*) - 1) * 0.99, 0) AS INT) + 1] AS p99 FROM lat GROUP BY 1""")
def v05(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_bars(spark, folder).withColumn("valid", F.size(quality.row_errors()) == 0)
    # The volume is added so that latencies differ.
    rows = rows.withColumn("v", ingest.latency_seconds() + F.col("volume"))
    base = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("received"), F.count_if("valid").alias("valid"),
        r(F.count_if("valid") / F.count(F.lit(1)) * 100).alias("quality_percent"),
        r(F.avg("v")).alias("average"), F.max("v").alias("maximum"),
    )
    ranks = exact_quantiles(rows, ["symbol"], "v", {
        "p50": (0.5, "nearest"), "p95": (0.95, "nearest"), "p99": (0.99, "nearest")})
    return base.join(ranks, "symbol")


@query("v06_provider_latency", RAW + "," + _LATENCY + """
SELECT symbol, arg_max(v, ingest_seq) AS latest, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
  round(quantile_cont(v, 0.99), 6) AS p99 FROM lat GROUP BY 1""")
def v06(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_bars(spark, folder).withColumn("v", ingest.latency_seconds() + F.col("volume"))
    newest = rows.groupBy("symbol").agg(F.max_by("v", "ingest_seq").alias("latest"))
    ranks = exact_quantiles(rows, ["symbol"], "v", {
        "p50": (0.5, "linear"), "p95": (0.95, "linear"), "p99": (0.99, "linear")})
    return newest.join(ranks.select("symbol", *[r(c).alias(c) for c in ("p50", "p95", "p99")]), "symbol")


@query("v07_stale_bars", sql.with_(sql.M15) + f"""
SELECT symbol, ts, {NOW_SQL} - ts > INTERVAL 30 MINUTE AS stale, {NOW_SQL} - ts > INTERVAL 50 MINUTE AS stale_delayed FROM bars""")
def v07(spark: SparkSession, folder: str) -> DataFrame:
    frame = F.lit("15m")
    return tables.m15_bars(spark, folder).select(
        "symbol", "ts", quality.is_stale(frame, F.col("ts"), now()).alias("stale"),
        quality.is_stale(frame, F.col("ts"), now(), delayed=True).alias("stale_delayed"))


@query("v08_missing_bars", sql.with_(sql.HOUR) + """
SELECT symbol, CASE WHEN bool_or(g > INTERVAL 1 HOUR) THEN 'MISSING' ELSE 'OK' END AS sequence
FROM (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM bars) GROUP BY 1
UNION ALL SELECT DISTINCT 'unverified:' || symbol, 'UNKNOWN' FROM bars""")
def v08(spark: SparkSession, folder: str) -> DataFrame:
    numbered = tables.hour_bars(spark, folder)
    known = quality.sequence_state(numbered, "60m", calendar_verified=True)
    unknown = quality.sequence_state(numbered, "60m", calendar_verified=False)
    return known.unionByName(unknown.withColumn("symbol", F.concat(F.lit("unverified:"), "symbol")))


@query("v09_completed_daily", sql.with_(sql.DAY) + """
SELECT symbol, ts FROM bars WHERE TIMESTAMP '2000-06-30 17:00:00' + INTERVAL 3 HOUR >= date_trunc('day', ts + INTERVAL 3 HOUR) + INTERVAL '18:40:00'""")
def v09(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2000-06-30 17:00:00").cast("timestamp")
    return tables.day_bars(spark, folder).filter(quality.completed_daily(F.col("ts"), now)).select("symbol", "ts")


@query("v10_completed_intraday", sql.with_(sql.M15) + f"""
SELECT symbol, ts FROM bars WHERE ts + INTERVAL 20 MINUTE <= {NOW_SQL}""")
def v10(spark: SparkSession, folder: str) -> DataFrame:
    done = quality.completed_intraday(F.col("ts"), 15, now(), delay_minutes=5)
    return tables.m15_bars(spark, folder).filter(done).select("symbol", "ts")


@query("v11_liquidity", sql.with_(sql.USER_HOUR) + """
SELECT symbol, CASE WHEN count(*) < 60 OR avg(volume) < 45 OR avg(close * volume) < 4500 THEN 'REJECTED_LOW_LIQUIDITY'
  WHEN arg_max(close, ts) < 100.5 THEN 'REJECTED_PRICE_FLOOR' END AS rejection FROM bars GROUP BY 1""")
def v11(spark: SparkSession, folder: str) -> DataFrame:
    return quality.liquidity_rejection(
        tables.user_hour_bars(spark, folder), min_value=4500, min_volume=45, min_bars=60, min_price=100.5)


@query("v12_stage_a", sql.with_(sql.USER_HOUR) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
s AS (SELECT symbol, max(n) AS n, avg((volume > 30)::INT) AS active0, avg((volume > 0)::INT) AS active,
  median(volume) FILTER (WHERE k > 1 AND volume > 0) AS usual, max(volume) FILTER (WHERE k = 1) AS v,
  max(close) FILTER (WHERE k = 1) AS c, max(close) FILTER (WHERE k = 2) AS p FROM ranked WHERE k <= 20 GROUP BY 1)
SELECT symbol, CASE WHEN n < 50 THEN 'LIMITED_HISTORY' WHEN active >= 0.8 THEN 'ELIGIBLE'
  WHEN coalesce(usual > 0 AND v >= usual * 3 AND abs(c / p - 1) >= 0.02, false) THEN 'EARLY_MOVER_OVERRIDE' ELSE 'LIQUIDITY_FILTER' END AS reason FROM s""")
def v12(spark: SparkSession, folder: str) -> DataFrame:
    return quality.stage_a_screen(tables.user_hour_bars(spark, folder))


@query("v12_stage_a_thin", sql.with_(sql.USER_HOUR) + """,
thin AS (SELECT symbol, ts, close, CASE WHEN volume < 60 THEN 0 ELSE volume - 55 END AS volume FROM bars),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM thin),
s AS (SELECT symbol, max(n) AS n, avg((volume > 0)::INT) AS active,
  median(volume) FILTER (WHERE k > 1 AND volume > 0) AS usual, max(volume) FILTER (WHERE k = 1) AS v,
  max(close) FILTER (WHERE k = 1) AS c, max(close) FILTER (WHERE k = 2) AS p FROM ranked WHERE k <= 20 GROUP BY 1)
SELECT symbol, CASE WHEN n < 30 THEN 'LIMITED_HISTORY' WHEN active >= 0.8 THEN 'ELIGIBLE'
  WHEN coalesce(usual > 0 AND v >= usual * 3 AND abs(c / p - 1) >= 0.02, false) THEN 'EARLY_MOVER_OVERRIDE' ELSE 'LIQUIDITY_FILTER' END AS reason FROM s""")
def v12_thin(spark: SparkSession, folder: str) -> DataFrame:
    volume = F.when(F.col("volume") < 60, 0.0).otherwise(F.col("volume") - 55)
    return quality.stage_a_screen(tables.user_hour_bars(spark, folder).withColumn("volume", volume), minimum_history=30)


@query("v13_compare_sources", RAW + """
SELECT symbol, ts, timeframe, coalesce(
  abs(a.open - b.open) / greatest(abs(a.open), abs(b.open), 1) <= 0.001 AND abs(a.high - b.high) / greatest(abs(a.high), abs(b.high), 1) <= 0.001
  AND abs(a.low - b.low) / greatest(abs(a.low), abs(b.low), 1) <= 0.001 AND abs(a.close - b.close) / greatest(abs(a.close), abs(b.close), 1) <= 0.001
  AND abs(a.volume - b.volume) / greatest(abs(a.volume), abs(b.volume), 1) <= 0.01, false) AS agree
FROM raw a JOIN (SELECT *, '15m' AS timeframe FROM bars) b USING (symbol, ts, timeframe) WHERE a.copy = 0""")
def v13(spark: SparkSession, folder: str) -> DataFrame:
    a = raw_bars(spark, folder).filter("copy = 0")
    b = tables.m15_bars(spark, folder).withColumn("timeframe", F.lit("15m"))
    out = quality.compare_sources(a, b)
    return out.withColumn("agree", F.coalesce("agree", F.lit(False)))


@query("v14_latest_price_compare", sql.with_(sql.TICKS, sql._event_bars("bars", "15 minutes"), sql._event_bars("slow", "1 hour")) + """
SELECT a.symbol, abs(a.c - b.c) / a.c * 100 <= 0.5 AS agree, round(a.c, 6) AS first_close, round(b.c, 6) AS second_close
FROM (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY 1) a
JOIN (SELECT symbol, arg_max(open, ts) AS c FROM slow GROUP BY 1) b ON a.symbol = b.symbol""")
def v14(spark: SparkSession, folder: str) -> DataFrame:
    a = tables.m15_bars(spark, folder).groupBy("symbol").agg(F.max_by("close", "ts").alias("a"))
    b = tables.hour_bars(spark, folder).groupBy("symbol").agg(F.max_by("open", "ts").alias("b"))
    near = F.abs(F.col("a") - F.col("b")) / F.col("a") * 100 <= 0.5
    return a.join(b, "symbol").select("symbol", near.alias("agree"), r("a").alias("first_close"), r("b").alias("second_close"))


@query("v15_corporate_action", sql.with_(sql.DAY) + """
SELECT symbol, ts, coalesce(abs(open / p - 1) * 100 > 25, false) AS suspected
FROM (SELECT symbol, ts, open, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)""")
def v15(spark: SparkSession, folder: str) -> DataFrame:
    s = blocked(tables.day_bars(spark, folder), halo=1)
    flag = quality.corporate_action(F.col("open"), F.lag("close").over(s.w))
    return s.add({"suspected": flag}).rows().select("symbol", "ts", "suspected")


@query("v16_symbol_mapping", """
SELECT c_custkey, CASE WHEN regexp_full_match(code, '[A-Z0-9]+') THEN code || '.IS' END AS vendor_symbol,
  CASE WHEN regexp_full_match(code, '[A-Z0-9]+') THEN code END AS canonical
FROM (SELECT c_custkey, upper(trim(CASE WHEN c_nationkey < 5 THEN c_name ELSE replace(c_name, '#', '') END)) AS code FROM customer)""")
def v16(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "customer")
    raw = F.when(F.col("c_nationkey") < 5, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("")))
    coded = rows.select("c_custkey", vendor.vendor_symbol(raw).alias("vendor_symbol"))
    return coded.withColumn("canonical", vendor.canonical_symbol(F.col("vendor_symbol")))


@query("v17_normalise_values", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS iso_ts,
  date_trunc('second', ts) AS epoch_ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS number FROM events""")
def v17(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 5 == 0, iso).otherwise(F.concat(iso, F.lit("Z")))
    number = F.when(F.col("event_id") % 7 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    return events.select(
        "event_id", vendor.zoned_timestamp(text).alias("iso_ts"),
        vendor.epoch_timestamp(F.unix_seconds("t").cast("string")).alias("epoch_ts"),
        vendor.finite_number(number).alias("number"))


_OPEN = "isodow({t} + INTERVAL 3 HOUR) <= 5 AND strftime({t} + INTERVAL 3 HOUR, '%H:%M:%S.%f') BETWEEN '10:00:00.000000' AND '18:10:00.000000'"


@query("v18_freshness", f"""
SELECT event_id, CASE WHEN NOT ({_OPEN.format(t="(ts + INTERVAL 1 HOUR)")}) THEN 'MARKET_CLOSED'
  WHEN m <= 45 THEN 'FRESH' WHEN m <= 135 THEN 'DELAYED' ELSE 'STALE' END AS state
FROM (SELECT event_id, ts, user_id + 0.0 AS m FROM events)""")
def v18(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    now = F.col("t") + F.expr("INTERVAL 1 HOUR")
    seen = now - F.make_dt_interval(mins=F.col("user_id").cast("int"))
    return events.select("event_id", quality.freshness_state(seen, now).alias("state"))


@query("v19_session", f"SELECT event_id, {_OPEN.format(t='ts')} AS in_session FROM events")
def v19(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    return events.select("event_id", quality.in_session(F.col("ts").cast("timestamp")).alias("in_session"))
