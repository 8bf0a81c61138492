"""Scalar functions the operators are made of, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.text import two_decimals
from barloom.plans.common import r
from barloom.sources.tables import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
ZONE = "Europe/Istanbul"


def query(name: str, oracle: str) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        ORACLES[name] = oracle
        return fn
    return register


@query("sc01_sc03_text", """
SELECT c_custkey, upper(trim(' ' || c_name || ' ')) AS code, regexp_full_match(replace(c_name, '#', ''), '[A-Za-z0-9]+') AS alnum, regexp_replace(c_name, '[^0-9]+', '-', 'g') AS digits,
  c_name[1:length(c_name) - 3] AS stem, contains(c_name, '01') AS has_01, lower(replace(c_mktsegment, 'BUILD', 'Mend')) AS segment FROM customer""")
def sc01(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        "c_custkey", F.upper(F.trim(F.concat(F.lit(" "), name, F.lit(" ")))).alias("code"),
        F.replace(name, F.lit("#"), F.lit("")).rlike("^[A-Za-z0-9]+$").alias("alnum"), F.regexp_replace(name, "[^0-9]+", "-").alias("digits"),
        F.substring(name, F.lit(1), F.length(name) - 3).alias("stem"), F.contains(name, F.lit("01")).alias("has_01"),
        F.lower(F.replace(F.col("c_mktsegment"), F.lit("BUILD"), F.lit("Mend"))).alias("segment"))


@query("sc05_formatting", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'ID:' || l_orderkey || ':' || l_linenumber || chr(10) || printf('%.2f', l_quantity) || 'x' AS message FROM lineitem""")
def sc05(spark: SparkSession, folder: str) -> DataFrame:
    head = F.concat_ws(":", F.lit("ID"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat_ws("\n", head, F.concat(two_decimals(F.col("l_quantity")), F.lit("x"))).alias("message"))



@query("sc05_two_decimals", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:.2f}', l_extendedprice * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END)) AS price,
  format('{:.2f}', (l_quantity - 25) / 8) AS eighths, format('{:.2f}', l_extendedprice * 1048576.125) AS large, format('{:.2f}', (l_discount - 0.05) / 2) AS small FROM lineitem""")
def sc05_decimals(spark: SparkSession, folder: str) -> DataFrame:
    """Negative, tied, large and small values."""
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        two_decimals(price * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).alias("price"),
        two_decimals((F.col("l_quantity") - 25) / 8).alias("eighths"), two_decimals(price * 1048576.125).alias("large"),
        two_decimals((F.col("l_discount") - 0.05) / 2).alias("small"))

@query("sc07_sc09_time", """
SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_date, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS local_time, isodow(ts + INTERVAL 3 HOUR) - 1 AS weekday, dayname(ts) AS day_name,
  hour(ts) AS hour, strftime(ts, '%H:%M') AS slot, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds, round(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / (365.2425 * 86400), 8) AS years
FROM events""")
def sc07(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    local = F.from_utc_timestamp("t", ZONE)
    seconds = F.unix_seconds("t") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return events.select(
        "event_id", F.to_date(local).alias("local_date"), F.date_format(local, "HH:mm").alias("local_time"), F.weekday(local).alias("weekday"),
        F.date_format("t", "EEEE").alias("day_name"), F.hour("t").alias("hour"), F.date_format("t", "HH:mm").alias("slot"),
        seconds.alias("seconds"), r(seconds / (365.2425 * 86400), 8).alias("years"))


@query("sc10_sc14_numbers", """
SELECT event_id, least(greatest(value, 5), 60) AS clipped, abs(value - 50) AS distance, floor(value)::BIGINT AS whole, round_even(value / 2, 0)::BIGINT AS half_even, round_even(value / 3, 2) AS cents,
  round(power(value + 1, 0.25), 8) AS fourth_root, round(sqrt(value), 8) AS root, round(ln(value + 1), 8) AS log, round(1 / (1 + exp(-least(greatest(value - 50, -30), 30))), 8) AS logistic,
  round(100 / nullif(floor(value), 0), 6) AS safe_ratio, value IS NOT NULL AND isfinite(value) AS finite FROM events""")
def sc10(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value")
    clipped = F.least(F.greatest(v - 50, F.lit(-30.0)), F.lit(30.0))
    return table(spark, folder, "events").select(
        "event_id", F.least(F.greatest(v, F.lit(5.0)), F.lit(60.0)).alias("clipped"), F.abs(v - 50).alias("distance"), F.floor(v).alias("whole"),
        F.bround(v / 2).cast("long").alias("half_even"), F.bround(v / 3, 2).alias("cents"), r(F.pow(v + 1, F.lit(0.25)), 8).alias("fourth_root"),
        r(F.sqrt(v), 8).alias("root"), r(F.ln(v + 1), 8).alias("log"), r(1 / (1 + F.exp(-clipped)), 8).alias("logistic"),
        r(F.lit(100.0) / F.nullif(F.floor(v).cast("double"), F.lit(0.0))).alias("safe_ratio"), (~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"))


@query("sc15_sc16_collections", """
SELECT c_custkey, least(c_acctbal * 1.5, c_acctbal * 2.5, c_acctbal * 3) AS lowest, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code,
  CASE WHEN c_nationkey < 5 THEN 'override' ELSE c_mktsegment END AS merged FROM customer""")
def sc15(spark: SparkSession, folder: str) -> DataFrame:
    levels = F.array(*[F.struct((F.col("c_acctbal") * m).alias("price")) for m in (1.5, 2.5, 3.0)])
    codes = F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2))
    base = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    extra = F.when(F.col("c_nationkey") < 5, F.create_map(F.lit("segment"), F.lit("override"))).otherwise(F.create_map(F.lit("other"), F.lit("-")))
    # The later map wins: keep the first map's keys that the second does not have.
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    return table(spark, folder, "customer").select(
        "c_custkey", F.array_min(F.transform(F.slice(levels, 1, 3), lambda x: x["price"])).alias("lowest"),
        F.coalesce(codes[F.col("c_mktsegment")], F.lit(0)).alias("code"), merged["segment"].alias("merged"))


@query("sc16_key_tally", "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def sc16(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("sc17_sc18_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0.0 AS missing, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def sc17(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.from_json("props", "k double, missing double")
    return table(spark, folder, "events").select(
        "event_id", fields["k"].alias("k"), F.coalesce(fields["missing"], F.lit(0.0)).alias("missing"),
        F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("digest"))


@query("sc19_safe_ratio", """
SELECT user_id, coalesce(round(count_if(event_type = 'purchase') * 1.0 / nullif(count_if(event_type IN ('purchase', 'view')), 0), 6), 0) AS conversion,
  round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS error_mean FROM events GROUP BY 1""")
def sc19(spark: SparkSession, folder: str) -> DataFrame:
    bought, seen = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "view"))
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.coalesce(r(F.try_divide(bought, seen)), F.lit(0.0)).alias("conversion"), r(F.avg(F.when(F.col("event_type") == "error", F.col("value")))).alias("error_mean"))
