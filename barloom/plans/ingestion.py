"""Source, sink and ingestion queries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ingest, quality, universe
from barloom.plans import sql
from barloom.plans.common import r
from barloom.plans.quality import NOW_SQL, RAW, now
from barloom.plans.raw import raw_bars
from barloom.schema import VALUES
from barloom.session import checkpoint_dir
from barloom.sources import files, sinks, tables, vendor

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _stamp(text: str):
    return F.lit(text).cast("timestamp")


# --- sources --------------------------------------------------------------------------------

@query("src01_csv_bars_range", sql.with_(sql.DAY) + """
SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'""")
def src01(spark: SparkSession, folder: str) -> DataFrame:
    path = _csv_copy(spark, folder)
    return files.csv_bars(spark, path, _stamp("1997-01-01"), _stamp("1999-12-31"))


def _csv_copy(spark: SparkSession, folder: str) -> str:
    path = scratch(spark, "csv")
    bars = tables.day_bars(spark, folder).select("symbol", F.col("ts").alias("timestamp"), *VALUES)
    bars.write.option("header", True).csv(path)
    return path


@query("src02_csv_tail", sql.with_(sql.DAY) + """
SELECT symbol, ts, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 260""")
def src02(spark: SparkSession, folder: str) -> DataFrame:
    return files.csv_tail(spark, _csv_copy(spark, folder), 260)


@query("src03_parquet_bars", sql.with_(sql.DAY) + """
SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol = 'ASIA' AND ts >= TIMESTAMP '1998-01-01'""")
def src03(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "parquet")
    tables.day_bars(spark, folder).write.partitionBy("symbol").parquet(path)
    return files.parquet_bars(spark, path, start=_stamp("1998-01-01"), symbol="ASIA").select("symbol", "ts", *VALUES)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Two data sets in one bar table: 15-minute and hourly bars."""
    m15 = tables.m15_bars(spark, folder).withColumns({"timeframe": F.lit("15m"), "dataset_id": F.lit("ds-15")})
    hour = tables.hour_bars(spark, folder).withColumns({"timeframe": F.lit("60m"), "dataset_id": F.lit("ds-60")})
    return m15.unionByName(hour).withColumn("provider", F.lit("events"))


_STORED_SQL = sql.with_(sql.TICKS, sql._event_bars("bars", "15 minutes"), sql._event_bars("hours", "1 hour"))


@query("src04_stored_bars", _STORED_SQL + "SELECT symbol, ts, close FROM hours")
def src04(spark: SparkSession, folder: str) -> DataFrame:
    return files.stored_bars(_stored(spark, folder), dataset_id="ds-60").select("symbol", "ts", "close")


@query("src05_active_stored_bars", _STORED_SQL + "SELECT symbol, ts, close FROM bars WHERE symbol IN ('click', 'purchase', 'view')")
def src05(spark: SparkSession, folder: str) -> DataFrame:
    bars = _stored(spark, folder)
    active = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("symbol").isin("click", "purchase", "view"))
    return files.stored_bars(bars, provider="events", timeframe="15m", active=active).select("symbol", "ts", "close")


def _universe_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as universe members, all columns as text."""
    return tables.table(spark, folder, "supplier").select(
        F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_name").alias("name"), F.lit("").alias("sector"),
        F.when(F.col("s_acctbal") > 0, "Yes").otherwise("0").alias("active"),
        F.lit("registry").alias("source"), F.lit("2024-01-30").alias("source_date"),
    )


@query("src06_universe_csv", """
SELECT 'S' || s_suppkey AS symbol, s_name AS name, CAST(NULL AS VARCHAR) AS sector, s_acctbal > 0 AS active, 'registry' AS source,
  DATE '2024-01-30' AS source_date FROM supplier""")
def src06(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "universe")
    _universe_raw(spark, folder).write.option("header", True).csv(path)
    return files.universe_csv(spark, path)


@query("src06_universe_checks", """
WITH rows AS (SELECT sha256('S' || s_suppkey || '|' || s_name || '||' || (s_acctbal > 0)::VARCHAR || '|registry|2024-01-30') AS h FROM supplier),
sizes AS (SELECT CASE WHEN count(*) <= 1024 THEN 1 WHEN count(*) <= 16384 THEN 2 WHEN count(*) <= 262144 THEN 3 ELSE 4 END AS d FROM rows),
l4 AS (SELECT d, substr(h, 1, d) AS p, sha256(string_agg(h || ':1', chr(10) ORDER BY h || ':1')) AS x FROM rows, sizes GROUP BY 1, 2),
l3 AS (SELECT d, substr(p, 1, 3) AS p, CASE WHEN d = 4 THEN sha256(string_agg(p || ':' || x, chr(10) ORDER BY p || ':' || x)) ELSE any_value(x) END AS x FROM l4 GROUP BY 1, 2),
l2 AS (SELECT d, substr(p, 1, 2) AS p, CASE WHEN d >= 3 THEN sha256(string_agg(p || ':' || x, chr(10) ORDER BY p || ':' || x)) ELSE any_value(x) END AS x FROM l3 GROUP BY 1, 2),
l1 AS (SELECT d, substr(p, 1, 1) AS p, CASE WHEN d >= 2 THEN sha256(string_agg(p || ':' || x, chr(10) ORDER BY p || ':' || x)) ELSE any_value(x) END AS x FROM l2 GROUP BY 1, 2)
SELECT sha256(string_agg(p || ':' || x, chr(10) ORDER BY p || ':' || x)) AS snapshot_hash, 0 AS invalid_symbols, 0 AS duplicate_symbols FROM l1""")
def src06_checks(spark: SparkSession, folder: str) -> DataFrame:
    members = files.universe_members(_universe_raw(spark, folder))
    return files.universe_hash(members).crossJoin(F.broadcast(files.universe_problems(members)))


# The driver's pages carry link lists and paragraphs instead of tables, so the registry walk is
# pointed at those tags: a link item with a menu word sets the section of what follows.
@query("src07_registry_rows")
def src07(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a registry row, under market headings made from the nations."""
    people = tables.table(spark, folder, "customer")
    markets = ("ANA PAZAR", "YILDIZ PAZAR", "EMTİA PAZARI", "GİRİŞİM SERMAYESİ PAZARI")
    heading = F.element_at(F.array(*[F.lit(m) for m in markets]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    row = F.format_string(
        "<tr><td>%d</td><td>c%d</td><td><b>%s</b></td></tr>", F.col("c_custkey"), F.col("c_custkey"), F.col("c_name"))
    page = people.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500).alias("part")).agg(
        F.concat(F.lit("<table><tr><th>"), F.first(heading), F.lit(" 12 Şirket / Fon Bulundu</th></tr>"),
                 F.concat_ws("", F.array_sort(F.collect_list(row))), F.lit("</table>")).alias("html"))
    pages = page.withColumn("page_id", F.col("part") * 100 + F.col("c_nationkey"))
    return vendor.registry_instruments(pages)


ORACLES["src07_registry_rows"] = """
SELECT 'C' || c_custkey AS symbol, c_name AS name, m AS market,
  CASE m WHEN 'EMTİA PAZARI' THEN 'COMMODITY' WHEN 'GİRİŞİM SERMAYESİ PAZARI' THEN 'FUND' ELSE 'EQUITY' END AS instrument_type,
  m IN ('ANA PAZAR', 'YILDIZ PAZAR') AS accepted
FROM (SELECT *, ['ANA PAZAR', 'YILDIZ PAZAR', 'EMTİA PAZARI', 'GİRİŞİM SERMAYESİ PAZARI'][c_nationkey % 4 + 1] AS m FROM customer)"""


@query("src07_page_rows")
def src07_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same walk over the raw pages, each with a registry table of its own at its end."""
    pages = tables.table(spark, folder, "pages")
    market = F.element_at(F.array(*[F.lit(m) for m in _PAGE_MARKETS]), (F.col("page_id") % 4 + 1).cast("int"))
    row = F.format_string("<tr class='r'><td>%d</td><td> p%d </td><td><a href='#'>Page %d</a></td></tr>", "page_id", "page_id", "page_id")
    own = F.concat(F.coalesce("html", F.lit("")), F.lit("<table><tr><th>"), market, F.lit(" 1 Şirket / Fon Bulundu</th></tr>"), row, F.lit("</table>"))
    return vendor.registry_instruments(pages.select("page_id", own.alias("html")))


_PAGE_MARKETS = ("ANA PAZAR", "YILDIZ PAZAR", "EMTİA PAZARI", "GİRİŞİM SERMAYESİ PAZARI")
ORACLES["src07_page_rows"] = """
SELECT 'P' || page_id AS symbol, 'Page ' || page_id AS name, m AS market,
  CASE m WHEN 'EMTİA PAZARI' THEN 'COMMODITY' WHEN 'GİRİŞİM SERMAYESİ PAZARI' THEN 'FUND' ELSE 'EQUITY' END AS instrument_type,
  m IN ('ANA PAZAR', 'YILDIZ PAZAR') AS accepted
FROM (SELECT page_id, ['ANA PAZAR', 'YILDIZ PAZAR', 'EMTİA PAZARI', 'GİRİŞİM SERMAYESİ PAZARI'][page_id % 4 + 1] AS m FROM pages)"""

_PAYLOAD_SQL = """SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE upper(event_type) END AS symbol,
  date_trunc('second', ts) AS ts, '15m' AS timeframe, value AS open, value + 2 AS high, value - 1 AS low, value + 1 AS close,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events"""


def _symbol_map(spark: SparkSession, folder: str, code) -> DataFrame:
    names = tables.table(spark, folder, "events").select("event_type").distinct().filter(F.col("event_type") != "signup")
    return names.select(code(F.col("event_type")).alias("vendor_symbol"), F.upper("event_type").alias("symbol"))


def _events_with_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "events").withColumns({
        "t": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k")})


@query("src08_vendor_a", _PAYLOAD_SQL)
def src08_a(spark: SparkSession, folder: str) -> DataFrame:
    e = _events_with_numbers(spark, folder)
    text = lambda c: c.cast("string")
    payload = F.to_json(F.struct(
        F.concat(F.lit("X:"), F.col("event_type")).alias("ticker"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.lit("15m").alias("interval"), text(F.col("value")).alias("o"), text(F.col("value") + 2).alias("h"),
        text(F.col("value") - 1).alias("l"), text(F.col("value") + 1).alias("c"), F.col("k").alias("v")))
    symbols = _symbol_map(spark, folder, lambda c: F.concat(F.lit("X:"), c))
    return vendor.normalise_a(e.select(payload.alias("payload")), symbols).select("symbol", "ts", "timeframe", *VALUES)


@query("src08_vendor_b", _PAYLOAD_SQL)
def src08_b(spark: SparkSession, folder: str) -> DataFrame:
    e = _events_with_numbers(spark, folder)
    text = lambda c: c.cast("string")
    payload = F.to_json(F.struct(
        F.concat(F.col("event_type"), F.lit(".IS")).alias("instrument"), F.unix_seconds("t").alias("ts"), F.lit("15m").alias("tf"),
        text(F.col("value")).alias("openPrice"), text(F.col("value") + 2).alias("highPrice"), text(F.col("value") - 1).alias("lowPrice"),
        text(F.col("value") + 1).alias("lastPrice"), F.col("k").alias("totalVolume")))
    symbols = _symbol_map(spark, folder, lambda c: F.concat(c, F.lit(".IS")))
    return vendor.normalise_b(e.select(payload.alias("payload")), symbols).select("symbol", "ts", "timeframe", *VALUES)


for _n in ("src08_vendor_a", "src08_vendor_b"):
    ORACLES[_n] = f"SELECT symbol, ts, timeframe, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM ({_PAYLOAD_SQL})"
    _fn = QUERIES[_n]
    QUERIES[_n] = (lambda fn: lambda spark, folder: fn(spark, folder).select(
        "symbol", "ts", "timeframe", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume"))(_fn)


@query("src09_wide_batch", sql.with_(sql.HOUR) + "SELECT symbol, ts, open, high, low, close, volume FROM bars")
def src09(spark: SparkSession, folder: str) -> DataFrame:
    bars = tables.hour_bars(spark, folder)
    symbols = ["click", "error", "purchase", "signup", "view"]
    wide = bars.groupBy("ts").pivot("symbol", symbols).agg(*[F.first(v).alias(v) for v in VALUES])
    named = wide.select("ts", *[F.col(f"{s}_{v}").alias(f"{v}_{s}") for s in symbols for v in VALUES])
    return vendor.flatten_batch(named)


@query("src10_cache_freshness", """
SELECT l_suppkey AS key, max(l_shipdate) AS saved_at FROM lineitem GROUP BY 1
HAVING TIMESTAMP '2001-11-05' - max(l_shipdate) <= INTERVAL 30 DAY AND count(*) % 2 = count(*) FILTER (WHERE l_returnflag = 'A') % 2""")
def src10(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(
        F.max(F.col("l_shipdate").cast("timestamp")).alias("saved_at"),
        (F.count(F.lit(1)) % 2).alias("content_hash"), (F.count_if(F.col("l_returnflag") == "A") % 2).alias("found"))
    found = lines.select("key", F.col("found").alias("content_hash"))
    return files.usable_cache(lines.drop("found"), found, _stamp("2001-11-05"), 30 * 86400).select("key", "saved_at")


# --- sinks ----------------------------------------------------------------------------------

@query("snk01_import_bars", sql.with_(sql.HOUR) + """
SELECT step, CASE step WHEN 1 THEN old WHEN 2 THEN 0 ELSE total - old END AS inserted, CASE step WHEN 1 THEN 0 WHEN 2 THEN old ELSE old END AS duplicates
FROM (SELECT count_if(ts < TIMESTAMP '2024-01-20') AS old, count(*) AS total FROM bars), (SELECT unnest([1, 2, 3]) AS step)""")
def snk01(spark: SparkSession, folder: str) -> DataFrame:
    """Import the first 19 days, the same again, then everything."""
    path = scratch(spark, "store")
    bars = tables.hour_bars(spark, folder).withColumns({
        "provider": F.lit("events"), "timeframe": F.lit("60m"), "ingest_seq": F.unix_seconds("ts")})
    early = bars.filter(F.col("ts") < _stamp("2024-01-20"))
    done = [sinks.import_bars(spark, part, path, 3600) for part in (early, early, bars)]
    rows = [(step, int(d["inserted"]), int(d["duplicates"])) for step, d in enumerate(done, 1)]
    return spark.createDataFrame(rows, "step int, inserted long, duplicates long")


@query("snk02_latest_report", """
SELECT 'scan' AS report_type, max(o_orderdate) AS created_at FROM (
  SELECT o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100) WHERE o_totalprice > 250000""")
def snk02(spark: SparkSession, folder: str) -> DataFrame:
    reports = tables.table(spark, folder, "orders").select(
        F.lit("scan").alias("report_type"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey / 1e6)")).alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
        F.when(F.col("o_totalprice") > 250000, F.array("o_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("candidates"))
    newest = sinks.latest_report(reports, "scan", require_candidates=True)
    return newest.select("report_type", F.col("day").alias("created_at"))


@query("snk03_append_absent", """
SELECT o_custkey AS key, count(DISTINCT o_orderkey) AS rows FROM orders GROUP BY 1""")
def snk03(spark: SparkSession, folder: str) -> DataFrame:
    """Appending overlapping batches twice leaves one row per key."""
    path = scratch(spark, "trades")
    rows = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("idempotency_key"), F.col("o_custkey").alias("key"))
    first = rows.filter(F.col("key") <= 900)
    for batch in (first, first.unionByName(first), rows):
        sinks.append_absent(spark, batch, path, ["idempotency_key"])
    return spark.read.parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


@query("snk04_json_safe", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio,
  printf('%.2f', l_extendedprice) AS price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00') AS shipped FROM lineitem""")
def snk04(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.table(spark, folder, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.round(F.col("l_tax") / F.nullif("l_discount", F.lit(0.0)), 6))
    return sinks.json_safe(lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_shipdate").cast("timestamp").alias("shipped")))


# --- ingestion ------------------------------------------------------------------------------

_ERRORS = """errs AS (SELECT *, (coalesce(least(open, high, low, close) <= 0, false))::INT + (volume < 0)::INT
  + (coalesce(low > open, false) OR coalesce(open > high, false) OR coalesce(low > close, false) OR coalesce(close > high, false))::INT
  + (received_at < ts)::INT AS k FROM raw)"""


@query("in01_row_validation", RAW + "," + _ERRORS + """
SELECT k AS errors, count(*) AS bars FROM errs GROUP BY 1""")
def in01(spark: SparkSession, folder: str) -> DataFrame:
    valid, bad = quality.split_valid(raw_bars(spark, folder))
    both = valid.select(F.lit(0).alias("errors")).unionByName(bad.select(F.size("errors").alias("errors")))
    return both.groupBy("errors").agg(F.count(F.lit(1)).alias("bars"))


_CLASSES = """ok AS (SELECT * FROM errs WHERE k = 0),
kept AS (SELECT symbol, ts, open AS o1, high AS h1, low AS l1, close AS c1, volume AS v1, ingest_seq AS s1
  FROM ok QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq) = 1),
cls AS (SELECT ok.symbol, CASE WHEN ingest_seq = s1 THEN 'new' WHEN open IS NOT DISTINCT FROM o1 AND high IS NOT DISTINCT FROM h1 AND low IS NOT DISTINCT FROM l1
  AND close IS NOT DISTINCT FROM c1 AND volume IS NOT DISTINCT FROM v1 THEN 'duplicate' ELSE 'revision' END AS c FROM ok JOIN kept USING (symbol, ts))"""


@query("in02_ingest_metrics", RAW + "," + _ERRORS + "," + _CLASSES + """
SELECT (SELECT count(*) FROM raw) AS bars_received, (SELECT count(*) FROM ok) AS bars_valid, (SELECT count(*) FROM errs WHERE k > 0) AS invalid_bars,
  count_if(c = 'new') AS new_bars, count_if(c = 'duplicate') AS duplicate_bars, count_if(c = 'revision') AS revised_bars,
  round((SELECT count(*) FROM ok) * 100.0 / (SELECT count(*) FROM raw), 6) AS quality_percent FROM cls""")
def in02(spark: SparkSession, folder: str) -> DataFrame:
    out = ingest.ingest_metrics(raw_bars(spark, folder))
    return out.withColumn("quality_percent", r("quality_percent"))


@query("in02_dry_run", RAW + "," + _ERRORS + """
SELECT (SELECT count(*) FROM raw) AS bars_received, count_if(k = 0) AS bars_valid, count_if(k > 0) AS invalid_bars, count_if(k = 0) AS new_bars,
  0 AS duplicate_bars, 0 AS revised_bars, round(count_if(k = 0) * 100.0 / count(*), 6) AS quality_percent FROM errs""")
def in02_dry(spark: SparkSession, folder: str) -> DataFrame:
    out = ingest.ingest_metrics(raw_bars(spark, folder), dry_run=True)
    return out.withColumn("quality_percent", r("quality_percent"))


@query("in02_manifest", RAW + "," + _ERRORS + """
SELECT count(DISTINCT symbol) AS symbols, min(ts) AS start, max(ts) AS "end", count(*) AS rows, false AS all_adjusted FROM errs WHERE k = 0""")
def in02_manifest(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = quality.split_valid(raw_bars(spark, folder))
    return ingest.manifest(valid)


@query("in03_merge_incremental", RAW + """
SELECT symbol, ts, open, high, low, close, volume FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY
  CASE WHEN ts < TIMESTAMP '2024-01-15' AND copy = 0 THEN 0 ELSE 1 END, ingest_seq) = 1""")
def in03(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_bars(spark, folder)
    stored = raw.filter((F.col("copy") == 0) & (F.col("ts") < _stamp("2024-01-15")))
    return ingest.merge_incremental(stored, raw).select("symbol", "ts", *VALUES)


@query("in03_merge_counts", RAW + """,
st AS (SELECT * FROM raw WHERE copy = 0 AND ts < TIMESTAMP '2024-01-15'),
kept AS (SELECT symbol, ts, open AS o1, high AS h1, low AS l1, close AS c1, volume AS v1, k, ingest_seq AS s1 FROM (
  SELECT *, 0 AS k FROM st UNION ALL SELECT *, 1 FROM raw) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY k, ingest_seq) = 1)
SELECT count_if(k = 1 AND ingest_seq = s1) AS inserted, count_if(NOT (k = 1 AND ingest_seq = s1) AND same) AS duplicates, count_if(NOT same) AS revisions
FROM (SELECT *, open IS NOT DISTINCT FROM o1 AND high IS NOT DISTINCT FROM h1 AND low IS NOT DISTINCT FROM l1 AND close IS NOT DISTINCT FROM c1
  AND volume IS NOT DISTINCT FROM v1 AS same FROM raw JOIN kept USING (symbol, ts))""")
def in03_counts(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_bars(spark, folder)
    stored = raw.filter((F.col("copy") == 0) & (F.col("ts") < _stamp("2024-01-15")))
    return ingest.classify(raw, stored).agg(
        F.sum("new_rows").alias("inserted"), F.sum("duplicates").alias("duplicates"), F.sum("revisions").alias("revisions"))


@query("in04_next_start", "SELECT max(ts) AS next_start FROM (" + sql.with_(sql.M15) + "SELECT ts FROM bars)")
def in04(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.next_start(tables.m15_bars(spark, folder), _stamp("2024-01-01"))


@query("in04_next_start_by_symbol", sql.with_(sql.M15) + """
SELECT symbol, max(ts) AS next_start FROM bars GROUP BY 1 UNION ALL SELECT r_name, TIMESTAMP '2024-01-01' FROM region""")
def in04_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Event symbols go on from their last bar; the regions have no bars of 15 minutes yet."""
    bars = tables.m15_bars(spark, folder)
    symbols = bars.select("symbol").unionByName(tables.table(spark, folder, "region").select(F.col("r_name").alias("symbol")))
    return ingest.next_starts(symbols, bars, _stamp("2024-01-01"))


def _vendor_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_bars(spark, folder)
    local = F.date_format(F.from_utc_timestamp("ts", "Europe/Istanbul"), "yyyy-MM-dd HH:mm:ss")
    text = {v: F.col(v).cast("string") for v in VALUES}
    text["volume"] = F.when(F.col("fault") == 9, "n/a").otherwise(F.col("volume").cast("string"))
    stamped = F.when(F.col("fault") == 10, F.concat(F.lit("bad "), local)).otherwise(local)
    return raw.select("symbol", stamped.alias("local_time"), *[text[v].alias(v) for v in VALUES], "ingest_seq")


_CONVERTED = """conv AS (SELECT *, CASE WHEN f = 10 THEN 'TIMESTAMP_ERROR' WHEN close IS NULL THEN 'NAN_OHLCV' WHEN f = 9 THEN 'INVALID_NUMERIC'
    WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE_PRICE' WHEN volume < 0 THEN 'NEGATIVE_VOLUME'
    WHEN low > open OR open > high OR low > close OR close > high THEN 'OHLC_INCONSISTENCY' END AS reason,
    count(*) OVER (PARTITION BY symbol, ts) AS copies
  FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq) = 1)"""


@query("in05_convert", RAW + "," + _CONVERTED + """
SELECT symbol, CASE WHEN f = 10 THEN NULL ELSE ts END AS ts, reason, copies FROM conv""")
def in05(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.convert(_vendor_rows(spark, folder)).select("symbol", "ts", "reason", "copies")


_CONV_QUALITY = _CONVERTED + """,
gaps AS (SELECT symbol, count_if(abs(open / p - 1) > 0.25) AS large_gaps, count_if(volume = 0) AS zero_volume, min(ts) AS first_timestamp, max(ts) AS last_timestamp
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM conv WHERE reason IS NULL) GROUP BY 1),
cq AS (SELECT symbol, sum(copies) AS bars_received, sum(copies - 1) AS duplicates, count_if(reason IS NULL) AS bars_valid,
  count_if(reason = 'TIMESTAMP_ERROR') AS timestamp_error, count_if(reason = 'NAN_OHLCV') AS nan_ohlcv, count_if(reason = 'INVALID_NUMERIC') AS invalid_numeric,
  count_if(reason = 'NON_POSITIVE_PRICE') AS non_positive_price, count_if(reason = 'NEGATIVE_VOLUME') AS negative_volume,
  count_if(reason = 'OHLC_INCONSISTENCY') AS ohlc_inconsistency, count_if(reason IS NOT NULL) AS invalid FROM conv GROUP BY 1)"""


@query("v04_in05_symbol_quality", RAW + "," + _CONV_QUALITY + """
SELECT cq.*, large_gaps, zero_volume, first_timestamp, last_timestamp, round((bars_received - invalid - duplicates) * 100.0 / bars_received, 6) AS quality_score,
  CAST(first_timestamp AS DATE) > DATE '2024-01-08' OR CAST(last_timestamp AS DATE) < DATE '2024-02-20' AS range_incomplete
FROM cq JOIN gaps USING (symbol)""")
def in05_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = ingest.conversion_quality(ingest.convert(_vendor_rows(spark, folder)), "15m", _stamp("2024-01-01"), _stamp("2024-02-27"))
    return out.withColumn("quality_score", r("quality_score"))


@query("in10_download_report", RAW + "," + _CONV_QUALITY + """
SELECT count(*) AS found_symbols, sum(bars_valid) AS valid_bars, sum(invalid) AS invalid_bars, sum(duplicates) AS duplicates, sum(timestamp_error) AS timestamp_error,
  sum(nan_ohlcv) AS nan_ohlcv, sum(invalid_numeric) AS invalid_numeric, sum(non_positive_price) AS non_positive_price, sum(negative_volume) AS negative_volume,
  sum(ohlc_inconsistency) AS ohlc_inconsistency, round(sum(bars_valid) * 100.0 / (sum(bars_valid) + sum(invalid)), 6) AS quality_score FROM cq""")
def in10(spark: SparkSession, folder: str) -> DataFrame:
    per = ingest.conversion_quality(ingest.convert(_vendor_rows(spark, folder)), "15m", _stamp("2024-01-01"), _stamp("2024-02-27"))
    return ingest.download_report(per).withColumn("quality_score", r("quality_score"))


@query("in06_dataset_hash", sql.with_(sql.M15) + """,
h AS (SELECT symbol, epoch_ms(ts)::BIGINT // 1000 // (900 * 1024) AS s, sha256(concat_ws('|', symbol, (epoch_ms(ts)::BIGINT // 1000)::VARCHAR, round(open * 1000000)::BIGINT::VARCHAR,
  round(high * 1000000)::BIGINT::VARCHAR, round(low * 1000000)::BIGINT::VARCHAR, round(close * 1000000)::BIGINT::VARCHAR, round(volume * 1000000)::BIGINT::VARCHAR)) AS x FROM bars),
a AS (SELECT symbol, s, sha256(string_agg(x, chr(10) ORDER BY x)) AS x FROM h GROUP BY 1, 2),
b AS (SELECT symbol, sha256(string_agg(x, chr(10) ORDER BY x)) AS x FROM a GROUP BY 1),
c AS (SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS x FROM b GROUP BY substr(x, 1, 3))
SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS dataset_hash FROM c""")
def in06(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.dataset_hash(tables.m15_bars(spark, folder), 900)


def _universe(spark: SparkSession, folder: str) -> DataFrame:
    """Previous universe: suppliers of nations 0-19; the accepted list holds nations 5-24."""
    return tables.table(spark, folder, "supplier").filter(F.col("s_nationkey") < 20).select(
        F.col("s_name").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("market"),
        (F.col("s_acctbal") > 0).alias("active"), _stamp("2023-01-01").alias("first_seen"), _stamp("2023-06-01").alias("last_seen"))


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "supplier").filter(F.col("s_nationkey") >= 5).select(
        F.col("s_name").alias("symbol"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("market"))


_REFRESH = """SELECT s_name AS symbol, s_name AS name, s_nationkey::VARCHAR AS market, s_nationkey >= 5 AS active,
  CASE WHEN s_nationkey < 20 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-30 12:00:00' END AS first_seen,
  CASE WHEN s_nationkey >= 5 THEN TIMESTAMP '2024-01-30 12:00:00' ELSE TIMESTAMP '2023-06-01' END AS last_seen,
  CASE WHEN s_nationkey >= 20 THEN 'NEW_SYMBOL' WHEN s_nationkey >= 5 THEN 'UNCHANGED' WHEN s_acctbal > 0 THEN 'INACTIVE' END AS event,
  'snap-2' AS snapshot_id FROM supplier"""


@query("in07_universe_refresh", _REFRESH)
def in07(spark: SparkSession, folder: str) -> DataFrame:
    return universe.refresh(_universe(spark, folder), _accepted(spark, folder), "snap-2", now())


@query("in07_membership_events", f"SELECT event, count(*) AS members FROM ({_REFRESH}) WHERE event IS NOT NULL GROUP BY 1")
def in07_events(spark: SparkSession, folder: str) -> DataFrame:
    merged = universe.refresh(_universe(spark, folder), _accepted(spark, folder), "snap-2", now())
    return universe.membership_events(merged).groupBy("event").agg(F.count(F.lit(1)).alias("members"))


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Users as instruments; the provider's answer depends on their newest event."""
    events = tables.table(spark, folder, "events")
    users = events.groupBy(F.col("user_id").cast("string").alias("symbol")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    dim = users.select("symbol", (F.col("last_type") != "signup").alias("active"),
                       F.lit("UNKNOWN").alias("provider_status"), F.lit("PENDING").alias("validation_status"))
    failure = F.when(F.col("last_type") == "error", "SYMBOL_DATA_UNAVAILABLE").when(F.col("last_type") == "view", "TIMEOUT")
    results = users.filter(F.col("last_type") != "purchase").select("symbol", failure.alias("failure"))
    return universe.record_results(dim, results)


_RECORDED = """us AS (SELECT user_id::VARCHAR AS symbol, arg_max(event_type, (ts, event_id)) AS lt FROM events GROUP BY 1),
rec AS (SELECT symbol, lt <> 'signup' AS active, CASE lt WHEN 'purchase' THEN 'UNKNOWN' WHEN 'error' THEN 'PROVIDER_UNAVAILABLE' WHEN 'view' THEN 'TEMPORARILY_DEGRADED' ELSE 'AVAILABLE' END AS provider_status,
  CASE lt WHEN 'purchase' THEN 'PENDING' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'FAILED' ELSE 'VALID' END AS validation_status FROM us)"""


@query("in08_record_results", "WITH " + _RECORDED + " SELECT * FROM rec")
def in08(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).select("symbol", "active", "provider_status", "validation_status")


@query("in09_update_summary", RAW + f""",
st AS (SELECT symbol, ts, open, high, low, close, volume FROM raw WHERE copy = 0 AND ts < TIMESTAMP '2024-01-28'),
done AS (SELECT * FROM raw WHERE ts + INTERVAL 15 MINUTE <= {NOW_SQL}),
ids AS (SELECT DISTINCT symbol, ts FROM done)
SELECT (SELECT count(*) FROM raw) AS downloaded, (SELECT count(*) FROM done) AS completed, (SELECT count(DISTINCT symbol) FROM raw) AS found_symbols,
  (SELECT max(ts) FROM raw) AS latest_provider, max(ts) AS latest_completed, (SELECT count(*) FROM ids ANTI JOIN st USING (symbol, ts)) AS inserted,
  (SELECT count(*) FROM done) - (SELECT count(*) FROM ids ANTI JOIN st USING (symbol, ts)) AS duplicates, max(ts) AS latest_persisted,
  {NOW_SQL} - max(ts) <= INTERVAL 45 MINUTE AS fresh, CASE WHEN {NOW_SQL} - max(ts) > INTERVAL 45 MINUTE THEN 'PROVIDER_OLD_BARS_ONLY' END AS reason FROM done""")
def in09(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_bars(spark, folder)
    stored = raw.filter((F.col("copy") == 0) & (F.col("ts") < _stamp("2024-01-28")))
    return ingest.update_summary(raw, stored, now())


# --- universe aggregates --------------------------------------------------------------------

@query("a01_bar_stats", sql.with_(sql.USER_HOUR) + "SELECT symbol, max(ts) AS last_ts, count(*) AS bars FROM bars GROUP BY 1")
def a01(spark: SparkSession, folder: str) -> DataFrame:
    return universe.bar_stats(tables.user_hour_bars(spark, folder))


@query("a02_universe_coverage", sql.with_(sql.USER_HOUR, _RECORDED) + """,
st AS (SELECT symbol, max(ts) AS m, count(*) AS n FROM bars GROUP BY 1),
j AS (SELECT rec.symbol, provider_status, provider_status = 'AVAILABLE' AS av, coalesce(TIMESTAMP '2024-01-30 23:00:00' - m <= INTERVAL 720 MINUTE, false) AS fr, coalesce(n, 0) AS n FROM rec LEFT JOIN st USING (symbol) WHERE active)
SELECT count(*) AS total_active, count_if(av) AS provider_available, count_if(fr) AS fresh, count_if(av AND fr AND n >= 50) AS eligible,
  count_if(av AND NOT fr) AS stale, count_if(provider_status = 'PROVIDER_UNAVAILABLE') AS provider_unavailable, count_if(av AND n < 50) AS limited_history,
  round_even(count_if(av AND fr AND n >= 50) * 100.0 / count(*), 2) AS coverage_percent FROM j""")
def a02(spark: SparkSession, folder: str) -> DataFrame:
    stats = universe.bar_stats(tables.user_hour_bars(spark, folder))
    return universe.coverage(_recorded(spark, folder), stats, _stamp("2024-01-30 23:00:00"), stale_minutes=720)


@query("a21_excluded_by_type", """
SELECT t AS instrument_type, count(*) AS instruments, count(DISTINCT c_mktsegment) AS segments FROM (
  SELECT *, CASE c_nationkey % 4 WHEN 2 THEN 'COMMODITY' WHEN 3 THEN 'FUND' END AS t FROM customer) WHERE t IS NOT NULL GROUP BY 1""")
def a21(spark: SparkSession, folder: str) -> DataFrame:
    listed = QUERIES["src07_registry_rows"](spark, folder).filter(~F.col("accepted"))
    people = tables.table(spark, folder, "customer").select(F.col("c_name").alias("name"), "c_mktsegment")
    return listed.join(people, "name").groupBy("instrument_type").agg(
        F.count(F.lit(1)).alias("instruments"), F.count_distinct("c_mktsegment").alias("segments"))
