"""Stateful queries: cooldown, alerts, lifecycle, health, order states, bar streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cooldown, health, lifecycle, quality, scoring
from barloom.plans import datasets as data
from barloom.plans import sql
from barloom.plans.common import m15_series, r
from barloom.plans.features import INTRADAY
from barloom.plans.labels import SIGNALS
from barloom.sources import tables
from barloom.staging import staged

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def now() -> Column:
    """The moment the queries are asked at."""
    return F.lit("2024-01-30 20:00:00").cast("timestamp")


NOW_SQL = "TIMESTAMP '2024-01-30 20:00:00'"


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


# The fold by definition: one recursion step per signal of a symbol.
FOLD = """fold AS (
  SELECT symbol, k, ts, score, ts AS a_ts, score AS a_score, 'SIGNAL_CREATED' AS decision FROM src WHERE k = 1
  UNION ALL
  SELECT s.symbol, s.k, s.ts, s.score,
    CASE WHEN f.a_ts < s.ts - INTERVAL 60 MINUTE OR s.score >= f.a_score + 5 THEN s.ts ELSE f.a_ts END,
    CASE WHEN f.a_ts < s.ts - INTERVAL 60 MINUTE OR s.score >= f.a_score + 5 THEN s.score ELSE f.a_score END,
    CASE WHEN f.a_ts < s.ts - INTERVAL 60 MINUTE THEN 'SIGNAL_CREATED' WHEN s.score >= f.a_score + 5 THEN 'SIGNAL_UPGRADED' ELSE 'REJECTED_COOLDOWN' END
  FROM fold f JOIN src s ON s.symbol = f.symbol AND s.k = f.k + 1)"""


@query("st04_cooldown", INTRADAY + """,
src AS MATERIALIZED (SELECT symbol, ts, radar_score AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM snap),
""" + FOLD + " SELECT symbol, ts, score, decision FROM fold")
def st04(spark: SparkSession, folder: str) -> DataFrame:
    snaps = data.snapshot_rows(spark, folder).select("symbol", "timeframe", "ts", F.col("radar_score").alias("score"))
    return cooldown.signal_decisions(snaps).select("symbol", "ts", "score", "decision")


@query("st04_cooldown_repeats", INTRADAY + """,
src AS MATERIALIZED (SELECT symbol, ts, radar_score AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM snap),
""" + FOLD + """ SELECT symbol, ts, score, decision FROM fold UNION ALL
SELECT symbol, ts, score - d, 'REJECTED_DUPLICATE' FROM fold, (SELECT unnest([0, 1]) AS d)""")
def st04_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal three times, once with a lower score: one decision each, the copies rejected."""
    snaps = data.snapshot_rows(spark, folder).select("symbol", "timeframe", "ts", F.col("radar_score").cast("long").alias("score"))
    lower = snaps.withColumn("score", F.col("score") - 1)
    return cooldown.signal_decisions(snaps.unionByName(lower).unionByName(snaps)).select("symbol", "ts", "score", "decision")


@query("st04_cooldown_by_user", sql.with_(sql.USER_HOUR, """src AS MATERIALIZED (
  SELECT symbol, ts, floor((high - 100) * 50)::BIGINT AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars)""",
  FOLD.replace("60 MINUTE", "10 HOUR"), recursive=True) + "SELECT symbol, ts, score, decision FROM fold")
def st04_users(spark: SparkSession, folder: str) -> DataFrame:
    """Every hourly bar of a user as a signal, ten hours of cooldown."""
    bars = tables.user_hour_bars(spark, folder).select(
        "symbol", "ts", F.lit("60m").alias("timeframe"), F.floor((F.col("high") - 100) * 50).cast("long").alias("score"))
    return cooldown.signal_decisions(bars, cooldown_minutes=600).select("symbol", "ts", "score", "decision")


@query("st05_alerts", INTRADAY + """,
cand AS (SELECT symbol, ts, copy, radar_score AS score, (n * 2 + copy) AS seq, ts + INTERVAL 20 MINUTE + copy * INTERVAL 1 MINUTE AS sent_at,
    CASE WHEN NOT (isodow(ts + INTERVAL 200 MINUTE) <= 5 AND strftime(ts + INTERVAL 200 MINUTE, '%H:%M:%S') BETWEEN '10:00:00' AND '18:10:00') THEN 'ALERT_SUPPRESSED_MARKET_CLOSED'
      WHEN radar_score < 80 THEN 'ALERT_SUPPRESSED_CLASS' END AS why
  FROM snap, (SELECT unnest([0, 1]) AS copy) c WHERE radar_score >= 70),
src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sent_at, seq) AS k FROM cand WHERE copy = 0),
walk AS (
  SELECT symbol, k, ts, score, seq, sent_at, CASE WHEN why IS NULL THEN sent_at END AS a_ts, CASE WHEN why IS NULL THEN score END AS a_score, why AS reason FROM src WHERE k = 1
  UNION ALL
  SELECT s.symbol, s.k, s.ts, s.score, s.seq, s.sent_at,
    CASE WHEN s.why IS NULL AND NOT coalesce(s.sent_at - w.a_ts < INTERVAL 60 MINUTE AND s.score < w.a_score + 5, false) THEN s.sent_at ELSE w.a_ts END,
    CASE WHEN s.why IS NULL AND NOT coalesce(s.sent_at - w.a_ts < INTERVAL 60 MINUTE AND s.score < w.a_score + 5, false) THEN s.score ELSE w.a_score END,
    CASE WHEN coalesce(s.sent_at - w.a_ts < INTERVAL 60 MINUTE AND s.score < w.a_score + 5, false) THEN 'ALERT_SUPPRESSED_COOLDOWN' ELSE s.why END
  FROM walk w JOIN src s ON s.symbol = w.symbol AND s.k = w.k + 1)
SELECT symbol, ts, seq, CASE WHEN reason IS NULL THEN 'SENT' ELSE 'SUPPRESSED' END AS status, reason FROM walk
UNION ALL SELECT symbol, ts, seq, 'DUPLICATE', 'ALERT_SUPPRESSED_DUPLICATE' FROM cand WHERE copy = 1""")
def st05(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate is dispatched 20 minutes after its bar and once more a minute later."""
    snaps = data.snapshot_rows(spark, folder).filter(F.col("radar_score") >= 70)
    twice = snaps.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "score": F.col("radar_score"), "seq": F.col("bar_no") * 2 + F.col("copy"),
        "sent_at": F.col("ts") + F.expr("INTERVAL 20 MINUTES") + F.col("copy") * F.expr("INTERVAL 1 MINUTE"),
    })
    first = F.col("sent_at") - F.col("copy") * F.expr("INTERVAL 1 MINUTE")
    ready = twice.withColumn("reason", scoring.alert_reason(first, 45, quality.in_session(first)))
    return cooldown.alert_decisions(ready).select("symbol", "ts", "seq", "status", "reason")


# --- lifecycle ------------------------------------------------------------------------------

def context_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("context", spark, folder, lambda: lifecycle.context_columns(m15_series(spark, folder)).rows())


def lifecycle_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored setups and events of all planned signals."""
    built: list[tuple[DataFrame, DataFrame]] = []

    def both() -> tuple[DataFrame, DataFrame]:
        if not built:
            built.append(lifecycle.evaluate(data.planned_signals(spark, folder), context_rows(spark, folder), now()))
        return built[0]

    events = staged("lifecycle_events", spark, folder, lambda: both()[1])
    setups = staged("lifecycle_setups", spark, folder, lambda: both()[0])
    return setups, events


@query("st06_lifecycle")
def st06(spark: SparkSession, folder: str) -> DataFrame:
    setups, _ = lifecycle_tables(spark, folder)
    money = ("entry_price", "active_stop", "exit_price", "mfe_r", "mae_r", "realized_r", "realized_r_after_cost")
    return setups.select("signal_id", "state", "outcome", "health", "action", F.concat_ws("|", "action_reason").alias("action_reason"), "entry_time", "exit_time", "highest_target",
                         "bars_to_entry", "bars_in_trade", *[r(c, 4).alias(c) for c in money])


@query("st06_lifecycle_events")
def st06_events(spark: SparkSession, folder: str) -> DataFrame:
    _, events = lifecycle_tables(spark, folder)
    return events.select("signal_id", "sequence", "event_time", "event_type", "state_from", "state_to", r("price", 4).alias("price"),
                         F.when(F.col("reason").isNotNull(), F.concat_ws("|", "reason")).alias("reason"), "zone_touched", "rule")


# The pre-entry half in SQL: first deciding bar of each setup.
PRE_ENTRY_SQL = f""",
ema AS (SELECT symbol, n, close AS e FROM num WHERE n = 0 UNION ALL
  SELECT b.symbol, b.n, q.e + (b.close - q.e) * 2 / 21 FROM ema q JOIN num b ON b.symbol = q.symbol AND b.n = q.n + 1),
cx AS (SELECT s.*, e, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, close / lag(close, 3) OVER w - 1 AS mom,
    CASE WHEN s.n >= 8 THEN volume / nullif(avg(volume) OVER (PARTITION BY s.symbol ORDER BY s.ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) END AS rv
  FROM num s JOIN ema ON ema.symbol = s.symbol AND ema.n = s.n WINDOW w AS (PARTITION BY s.symbol ORDER BY s.ts)),
sb AS (SELECT g.signal_id, g.zone_low, g.zone_high, g.stop, g.t1, g.rvol AS rv0, b.n - g.n AS i, b.ts AS bts, b.open, b.high, b.low, b.close, b.e, b.vwap, b.mom, b.rv
  FROM sig g JOIN cx b ON b.symbol = g.symbol AND b.n > g.n AND b.n <= g.n + 24 WHERE b.ts <= {NOW_SQL} - INTERVAL 15 MINUTE AND g.zone_low IS NOT NULL),
dc AS (SELECT *, CASE WHEN coalesce(close < vwap AND close < e AND mom < -0.01, false) THEN 'CANCELLED_STRUCTURE'
    WHEN i >= 3 AND coalesce(rv < greatest(0.5, rv0 * 0.35) AND mom < 0, false) THEN 'CANCELLED_DECAY' WHEN i >= 8 THEN 'EXPIRED'
    WHEN close > zone_high + (zone_high - stop) * 0.5 THEN 'CHASED' WHEN low <= zone_high AND high >= zone_low THEN 'ENTRY_READY' END AS d FROM sb),
pp AS (SELECT signal_id, min(i) AS p, arg_min(d, i) AS d FROM dc WHERE d IS NOT NULL GROUP BY 1),
gt AS (SELECT dc.signal_id, bts, open, CASE WHEN open > zone_high + greatest(open - stop, 0) * 0.5 THEN 'CHASED'
    WHEN open - stop <= 0 OR (t1 - open) / nullif(open - stop, 0) < 2 THEN 'NO_ENTRY' ELSE 'ENTRY_ACTIVATED' END AS g
  FROM dc JOIN pp ON pp.signal_id = dc.signal_id AND dc.i = pp.p + 1 AND pp.d = 'ENTRY_READY')"""


@query("st06_entry_decisions", SIGNALS + PRE_ENTRY_SQL + """
SELECT pp.signal_id, p AS decision_bar, pp.d AS decision, g AS gate, CASE WHEN g = 'ENTRY_ACTIVATED' THEN bts END AS entry_time,
  CASE WHEN g = 'ENTRY_ACTIVATED' THEN round(open, 6) END AS entry_price FROM pp LEFT JOIN gt ON gt.signal_id = pp.signal_id""")
def st06_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = lifecycle.setup_bars(data.planned_signals(spark, folder), context_rows(spark, folder), now())
    decided = rows.filter(F.col("p").isNotNull())
    return decided.groupBy("signal_id").agg(
        F.first("p.i").alias("decision_bar"), F.first("p.decision").alias("decision"), F.first("gate").alias("gate"),
        F.max(F.when(F.col("i") == F.col("e"), F.col("bar_ts"))).alias("entry_time"), r(F.first("entry")).alias("entry_price"))


# The rules by definition: one recursion step per bar of a setup.
WALK_SQL = PRE_ENTRY_SQL.replace("b.e, b.vwap, b.mom, b.rv\n", "b.e, b.vwap, b.mom, b.rv, b.atr14, g.t2, g.t3, g.ts AS sts\n").replace(
    "e, sum((high + low + close)", "e, avg(tr) OVER (PARTITION BY s.symbol ORDER BY s.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr14, sum((high + low + close)").replace(
    "FROM num s JOIN ema", "FROM (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0), coalesce(abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0)) AS tr FROM num) s JOIN ema") + """,
nx AS MATERIALIZED (SELECT *, lead(open) OVER w AS no, lead(bts) OVER w AS nts FROM dc WINDOW w AS (PARTITION BY signal_id ORDER BY i)),
walk AS (
  SELECT signal_id, 0::BIGINT AS i, 'PRE' AS ph, NULL::DOUBLE AS entry, NULL::TIMESTAMP AS ets, NULL::BIGINT AS ei, stop AS act, 0 AS hi, 0::DOUBLE AS mfe, 0::DOUBLE AS mae, NULL::VARCHAR AS outcome, NULL::DOUBLE AS xp, NULL::TIMESTAMP AS xts
  FROM sig WHERE zone_low IS NOT NULL AND ts <= """ + NOW_SQL + """ - INTERVAL 15 MINUTE
  UNION ALL
  SELECT signal_id, i, CASE WHEN oc IS NOT NULL THEN 'DONE' WHEN inside THEN 'IN' WHEN d = 'ENTRY_READY' THEN 'READY' ELSE ph END, en, et, e2, act2, hi2, mf, ma, oc, xprice, xtime
  FROM (SELECT w.signal_id, b.i, w.ph, b.d,
      CASE WHEN w.ph = 'READY' THEN CASE WHEN b.open > zone_high + greatest(b.open - b.stop, 0) * 0.5 THEN 'CHASED' WHEN b.open - b.stop <= 0 OR (t1 - b.open) / nullif(b.open - b.stop, 0) < 2 THEN 'NO' ELSE 'IN' END END AS g,
      coalesce(w.ph = 'IN' OR g = 'IN', false) AS inside, CASE WHEN g = 'IN' THEN b.open ELSE w.entry END AS en, CASE WHEN g = 'IN' THEN b.bts ELSE w.ets END AS et, CASE WHEN g = 'IN' THEN b.i ELSE w.ei END AS e2,
      en - b.stop AS risk, CASE WHEN inside THEN greatest(w.mfe, (b.high - en) / risk) ELSE w.mfe END AS mf, CASE WHEN inside THEN least(w.mae, (b.low - en) / risk) ELSE w.mae END AS ma,
      inside AND b.low <= w.act AS hs, CASE WHEN inside AND NOT hs THEN greatest(w.hi, CASE WHEN b.high >= t3 THEN 3 WHEN b.high >= t2 THEN 2 WHEN b.high >= t1 THEN 1 ELSE 0 END) ELSE w.hi END AS hi2,
      inside AND NOT hs AND hi2 = 3 AS x3, CASE WHEN hi2 >= 1 AND w.hi = 0 THEN greatest(w.act, en) ELSE w.act END AS act1,
      CASE WHEN inside AND NOT hs AND NOT x3 AND hi2 >= 1 THEN greatest(act1, least(b.close - 2 * atr14, b.close)) ELSE act1 END AS act2, b.i - e2 + 1 AS held,
      CASE WHEN inside AND NOT hs AND NOT x3 THEN CASE WHEN held >= 4 AND hi2 = 0 AND b.mom < -0.01 AND b.close < b.vwap THEN 'THESIS' WHEN held >= 16 THEN 'TIME' END END AS lv, lv IS NOT NULL AND b.no IS NOT NULL AS cl,
      CASE WHEN hs THEN w.act WHEN x3 THEN t3 WHEN cl THEN b.no END AS xprice, CASE WHEN hs OR x3 THEN b.bts WHEN cl THEN b.nts END AS xtime, (xprice - en) / risk AS rr,
      CASE WHEN w.ph = 'PRE' AND b.d = 'CANCELLED_DECAY' THEN 'NO_ENTRY_DECAY' WHEN w.ph = 'PRE' AND b.d = 'CANCELLED_STRUCTURE' THEN 'NO_ENTRY_STRUCTURE' WHEN w.ph = 'PRE' AND b.d = 'EXPIRED' THEN 'NO_ENTRY_EXPIRED'
        WHEN w.ph = 'PRE' AND b.d = 'CHASED' OR g = 'CHASED' THEN 'CHASED' WHEN g = 'NO' THEN 'NO_ENTRY_STRUCTURE' WHEN hs AND w.hi = 0 THEN 'STOP_BEFORE_H1' WHEN hs THEN 'TRAILING_EXIT' WHEN x3 THEN 'H3_EXIT'
        WHEN cl AND lv = 'THESIS' THEN 'THESIS_INVALIDATED' WHEN cl AND rr > 0.1 THEN 'TIME_EXIT_PROFIT' WHEN cl AND rr < -0.1 THEN 'TIME_EXIT_LOSS' WHEN cl THEN 'TIME_EXIT_FLAT' END AS oc
    FROM walk w JOIN nx b ON b.signal_id = w.signal_id AND b.i = w.i + 1 WHERE w.ph <> 'DONE') q),
fin AS MATERIALIZED (SELECT w.*, s.stop, s.ts AS sts, s.symbol, (xp - entry) / (entry - s.stop) AS rr FROM walk w JOIN sig s ON s.signal_id = w.signal_id QUALIFY row_number() OVER (PARTITION BY w.signal_id ORDER BY w.i DESC) = 1)"""


@query("st06_lifecycle_results", SIGNALS + WALK_SQL + """
SELECT signal_id, outcome, ets AS entry_time, round(entry, 6) AS entry_price, xts AS exit_time, round(xp, 4) AS exit_price, hi AS highest_target, round(mfe, 4) AS mfe_r, round(mae, 4) AS mae_r,
  round(rr, 4) AS realized_r, CASE WHEN entry IS NOT NULL THEN round(act, 4) END AS active_stop FROM fin""")
def st06_results(spark: SparkSession, folder: str) -> DataFrame:
    setups, _ = lifecycle_tables(spark, folder)
    return setups.select("signal_id", "outcome", "entry_time", r("entry_price").alias("entry_price"), "exit_time", r("exit_price", 4).alias("exit_price"), "highest_target",
                         *[r(c, 4).alias(c) for c in ("mfe_r", "mae_r", "realized_r", "active_stop")])


@query("st07_event_sync")
def st07(spark: SparkSession, folder: str) -> DataFrame:
    """Only what a run at noon of 15 January had not written, for setups still open then."""
    early_now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    signals = data.planned_signals(spark, folder)
    old_setups, old_events = lifecycle.evaluate(
        signals.filter(F.col("ts") <= early_now), context_rows(spark, folder), early_now)
    _, events = lifecycle_tables(spark, folder)
    fresh = lifecycle.new_events(events, old_events, old_setups)
    return fresh.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("a10_lifecycle_totals", SIGNALS + WALK_SQL + """,
v AS (SELECT list_sort(list(rr - 0.002)) AS l, avg(rr - 0.002) AS m FROM fin WHERE outcome IS NOT NULL AND rr IS NOT NULL),
h AS (SELECT f.signal_id, min(b.bts) AS t FROM fin f JOIN nx b ON b.signal_id = f.signal_id AND f.hi >= 1 AND b.i >= f.ei AND b.high >= b.t1 GROUP BY 1)
SELECT count(*) AS planned, count(ets) AS entry_activated, round(count(ets) * 1.0 / count(*), 6) AS activation_rate, round(any_value(m), 6) AS expected_r, round(any_value(l[len(l) // 2 + 1]), 6) AS median_realized_r,
  round(median(date_diff('second', sts, ets) / 60.0), 6) AS median_minutes_to_entry, round(median(date_diff('second', ets, t) / 60.0), 6) AS median_minutes_to_h1 FROM fin LEFT JOIN h ON h.signal_id = fin.signal_id, v""")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    totals, _ = lifecycle.analytics(*lifecycle_tables(spark, folder))
    return totals.select("planned", "entry_activated", *[r(c).alias(c) for c in (
        "activation_rate", "expected_r", "median_realized_r", "median_minutes_to_entry", "median_minutes_to_h1")])


@query("a10_lifecycle_outcomes", SIGNALS + WALK_SQL + "SELECT outcome, count(*) AS setups FROM fin WHERE outcome IS NOT NULL GROUP BY 1")
def a10_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.analytics(*lifecycle_tables(spark, folder))[1]


# --- runs and transitions -------------------------------------------------------------------

@query("st09_provider_health", """
WITH RECURSIVE src AS MATERIALIZED (SELECT user_id, event_id, ts, event_type NOT IN ('error', 'view', 'signup') AS ok,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (
  SELECT user_id, event_id, k, ok, CASE WHEN ok THEN 1 ELSE 0 END AS good, CASE WHEN ok THEN 0 ELSE 1 END AS bad, CASE WHEN ok THEN 'UNKNOWN' ELSE 'DEGRADED' END AS health FROM src WHERE k = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.k, s.ok, CASE WHEN s.ok THEN w.good + 1 ELSE 0 END, CASE WHEN s.ok THEN 0 ELSE w.bad + 1 END,
    CASE WHEN NOT s.ok THEN CASE WHEN w.bad + 1 >= 3 THEN 'DOWN' ELSE 'DEGRADED' END WHEN w.good + 1 >= 2 THEN 'HEALTHY' ELSE w.health END
  FROM walk w JOIN src s ON s.user_id = w.user_id AND s.k = w.k + 1)
SELECT user_id, event_id, health FROM walk""")
def st09(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.table(spark, folder, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (~F.col("event_type").isin("error", "view", "signup")).alias("ok"))
    days = F.floor(F.unix_seconds("ts") / 86400)
    return health.provider_health(log, ["user_id"], ["ts", "event_id"], days).select("user_id", "event_id", "health")


_STATES = ("SIGNAL_CREATED", "PENDING_ENTRY", "OPEN", "PARTIALLY_EXITED", "CLOSED", "CANCELLED", "REJECTED")


@query("st10_order_states", """
WITH s AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_linenumber % 7 AS st FROM lineitem),
n AS (SELECT order_id, seq, ['SIGNAL_CREATED', 'PENDING_ENTRY', 'OPEN', 'PARTIALLY_EXITED', 'CLOSED', 'CANCELLED', 'REJECTED'][st + 1] AS state FROM s),
p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY order_id ORDER BY seq), 'SIGNAL_CREATED') AS previous FROM n)
SELECT order_id, seq, previous, state FROM p WHERE NOT (seq = 1 AND state = 'SIGNAL_CREATED') AND previous || '>' || state NOT IN (
  'SIGNAL_CREATED>PENDING_ENTRY', 'SIGNAL_CREATED>REJECTED', 'SIGNAL_CREATED>CANCELLED', 'PENDING_ENTRY>OPEN', 'PENDING_ENTRY>REJECTED', 'PENDING_ENTRY>CANCELLED',
  'OPEN>PARTIALLY_EXITED', 'OPEN>CLOSED', 'PARTIALLY_EXITED>CLOSED')""")
def st10(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    lines = tables.table(spark, folder, "lineitem")
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    named = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    states = lines.select(F.col("l_orderkey").alias("order_id"), F.row_number().over(over).alias("seq"), named.alias("state"))
    return health.illegal_changes(states).select("order_id", "seq", "previous", "state")


@query("st02_completed_bars", sql.with_(sql.M15) + f"SELECT symbol, ts, close FROM bars WHERE ts + INTERVAL 15 MINUTE + INTERVAL 15 MINUTE <= {NOW_SQL}")
def st02(spark: SparkSession, folder: str) -> DataFrame:
    """Batch form of the watermark rule: interval plus delay must have passed."""
    done = quality.completed_intraday(F.col("ts"), 15, now(), delay_minutes=15)
    return tables.m15_bars(spark, folder).filter(done).select("symbol", "ts", "close")
