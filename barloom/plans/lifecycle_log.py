"""Event log, plan versions and newest setups of the lifecycle, with the rules bar by bar as oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import lifecycle
from barloom.plans import datasets as data
from barloom.plans.common import r
from barloom.plans.labels import SIGNALS
from barloom.operators.labels import completed
from barloom.plans.ingestion import scratch
from barloom.plans.stateful import NOW_SQL, WALK_SQL, context_rows, lifecycle_tables, now
from barloom.plans.streams import _by_time, _feed
from barloom.streaming import lifecycle as stream_lifecycle

QUERIES: dict[str, Callable] = {}


def _health_text(kind: str) -> str:
    return "'" + "|".join(lifecycle.HEALTH_REASONS[kind]) + "'"


# One recursion step per bar, with the state that the bar leaves behind.
STEPS = f""",
hl AS MATERIALIZED (SELECT *, CASE WHEN coalesce(close < vwap AND close < e AND mom < -0.01, false) THEN 'GEÇERSİZ'
    WHEN i >= 3 AND coalesce(rv < greatest(0.5, rv0 * 0.35) AND mom < 0, false) THEN 'BOZULDU'
    WHEN i >= 3 AND rv IS NOT NULL AND rv0 IS NOT NULL AND mom IS NOT NULL AND (rv < rv0 * 0.6 OR mom < 0) THEN 'ZAYIFLIYOR' ELSE 'GÜÇLÜ' END AS health FROM nx),
step AS (
  SELECT signal_id, 0::BIGINT AS i, 'PRE' AS ph, NULL::DOUBLE AS en, NULL::BIGINT AS ei, stop AS act, 0 AS hi, 0::DOUBLE AS mfe, 'DETECTED' AS st,
    NULL::VARCHAR AS r_ph0, NULL::VARCHAR AS r_st0, stop AS r_act0, 0 AS r_hi0, NULL::VARCHAR AS r_g, false AS r_hs, false AS r_goes, stop AS r_act1, NULL::VARCHAR AS r_lv, false AS r_cl, false AS r_stall, false AS r_calm
  FROM sig WHERE zone_low IS NOT NULL AND ts <= {NOW_SQL} - INTERVAL 15 MINUTE
  UNION ALL
  SELECT signal_id, i, CASE WHEN hs OR x3 OR cl OR g IN ('CHASED', 'NO_ENTRY') OR (ph0 = 'PRE' AND d IS NOT NULL AND d <> 'ENTRY_READY') THEN 'DONE' WHEN inside THEN 'IN' WHEN d = 'ENTRY_READY' AND ph0 = 'PRE' THEN 'READY' ELSE ph0 END,
    en2, ei2, act2, hi2, mf, CASE WHEN ph0 = 'PRE' THEN coalesce(d, waits) WHEN g IN ('CHASED', 'NO_ENTRY') THEN g WHEN hs AND hi0 = 0 THEN 'HARD_STOP' WHEN hs THEN 'TRAILING_STOP' WHEN x3 THEN 'H3_REACHED'
      WHEN cl THEN lv WHEN stall THEN 'STALLED' WHEN calm THEN 'ACTIVE' ELSE s1 END, ph0, st0, act0, hi0, g, hs, goes, act1, lv, cl, stall, calm
  FROM (SELECT w.signal_id, b.i, w.ph AS ph0, w.st AS st0, w.act AS act0, w.hi AS hi0, b.d, CASE WHEN b.close > zone_high THEN 'WAITING_PULLBACK' ELSE 'ARMED' END AS waits,
      CASE WHEN w.ph = 'READY' THEN CASE WHEN b.open > zone_high + greatest(b.open - b.stop, 0) * 0.5 THEN 'CHASED' WHEN b.open - b.stop <= 0 OR (t1 - b.open) / nullif(b.open - b.stop, 0) < 2 THEN 'NO_ENTRY' ELSE 'ENTRY_ACTIVATED' END END AS g,
      coalesce(w.ph = 'IN' OR g = 'ENTRY_ACTIVATED', false) AS inside, CASE WHEN g = 'ENTRY_ACTIVATED' THEN b.open ELSE w.en END AS en2, CASE WHEN g = 'ENTRY_ACTIVATED' THEN b.i ELSE w.ei END AS ei2,
      CASE WHEN inside THEN greatest(w.mfe, (b.high - en2) / (en2 - b.stop)) ELSE w.mfe END AS mf, inside AND b.low <= w.act AS hs,
      CASE WHEN inside AND NOT hs THEN greatest(w.hi, CASE WHEN b.high >= t3 THEN 3 WHEN b.high >= t2 THEN 2 WHEN b.high >= t1 THEN 1 ELSE 0 END) ELSE w.hi END AS hi2,
      inside AND NOT hs AND hi2 = 3 AS x3, inside AND NOT hs AND NOT x3 AS goes, CASE WHEN hi2 >= 1 AND w.hi = 0 THEN greatest(w.act, en2) ELSE w.act END AS act1,
      CASE WHEN goes AND hi2 >= 1 THEN greatest(act1, least(b.close - 2 * atr14, b.close)) ELSE act1 END AS act2, b.i - ei2 + 1 AS held,
      CASE WHEN goes THEN CASE WHEN held >= 4 AND hi2 = 0 AND b.mom < -0.01 AND b.close < b.vwap THEN 'THESIS_INVALIDATED' WHEN held >= 16 THEN 'TIME_EXIT' END END AS lv, lv IS NOT NULL AND b.no IS NOT NULL AS cl,
      CASE WHEN act2 > act1 THEN 'PROGRESSING' WHEN hi2 >= 2 AND w.hi < 2 THEN 'H2_REACHED' WHEN hi2 >= 1 AND w.hi < 1 THEN CASE WHEN act1 > w.act THEN 'PROGRESSING' ELSE 'H1_REACHED' END
        WHEN g = 'ENTRY_ACTIVATED' THEN g ELSE w.st END AS s1,
      goes AND s1 <> 'STALLED' AND CASE WHEN lv = 'TIME_EXIT' THEN hi2 = 0 AND mf <= 0.5 WHEN lv IS NULL THEN held >= 8 AND mf < 0.5 ELSE false END AS stall,
      goes AND lv IS NULL AND NOT (held >= 8 AND mf < 0.5) AND s1 NOT IN ('PROGRESSING', 'H1_REACHED', 'H2_REACHED') AS calm
    FROM step w JOIN nx b ON b.signal_id = w.signal_id AND b.i = w.i + 1 WHERE w.ph <> 'DONE') q),
met AS MATERIALIZED (SELECT s.signal_id, s.i, s.en, s.ei, s.act, s.hi, s.st, s.r_ph0 AS ph0, s.r_st0 AS st0, s.r_act0 AS act0, s.r_hi0 AS hi0, s.r_g AS g, s.r_hs AS hs, s.r_goes AS goes, s.r_act1 AS act1, s.r_lv AS lv, s.r_cl AS cl, s.r_stall AS stall, s.r_calm AS calm, b.* EXCLUDE (signal_id, i), CASE b.health WHEN 'GEÇERSİZ' THEN {_health_text(lifecycle.HEALTH_INVALID)} WHEN 'BOZULDU' THEN {_health_text(lifecycle.HEALTH_BROKEN)}
    WHEN 'ZAYIFLIYOR' THEN {_health_text(lifecycle.HEALTH_WEAK)} ELSE {_health_text(lifecycle.HEALTH_GOOD)} END AS why FROM step s JOIN hl b ON b.signal_id = s.signal_id AND b.i = s.i),
said AS (
  SELECT signal_id, 0::BIGINT AS i, 0 AS k, ts AS event_time, 'SIGNAL_DETECTED' AS event_type, 'DETECTED' AS state_to, NULL::DOUBLE AS price, NULL::VARCHAR AS reason, NULL::BOOLEAN AS zone_touched, NULL::VARCHAR AS rule
    FROM sig WHERE zone_low IS NOT NULL AND ts <= {NOW_SQL} - INTERVAL 15 MINUTE
  UNION ALL SELECT signal_id, i, 0, bts, 'STATE_REVIEW', 'ARMED', NULL, '{lifecycle.FIRST_BAR_REASON}', NULL, NULL FROM met WHERE i = 1
  UNION ALL SELECT signal_id, i, 1, bts, CASE g WHEN 'CHASED' THEN 'ENTRY_REJECTED_CHASE' WHEN 'NO_ENTRY' THEN 'ENTRY_REJECTED_RR' ELSE 'ENTRY_FILLED_NEXT_OPEN' END, g, open, CASE WHEN g = 'NO_ENTRY' THEN '{lifecycle.RISK_REWARD_REASON}' END, NULL, NULL FROM met WHERE g IS NOT NULL
  UNION ALL SELECT signal_id, i, 2, bts, 'SETUP_REVIEWED', st, NULL, why, NULL, NULL FROM met WHERE ph0 = 'PRE' AND d IS NULL AND st <> CASE WHEN i = 1 THEN 'ARMED' ELSE st0 END
  UNION ALL SELECT signal_id, i, 3, bts, CASE d WHEN 'EXPIRED' THEN 'ENTRY_TTL_EXPIRED' WHEN 'CHASED' THEN 'SETUP_CHASED' WHEN 'ENTRY_READY' THEN 'ENTRY_CONDITIONS_READY' ELSE 'SETUP_INVALIDATED' END, d, close,
    CASE WHEN d NOT IN ('EXPIRED', 'CHASED') THEN why END, CASE WHEN d LIKE 'CANCELLED%' THEN low <= zone_high AND high >= zone_low END, NULL FROM met WHERE ph0 = 'PRE' AND d IS NOT NULL
  UNION ALL SELECT signal_id, i, 4, bts, st, st, act0, NULL, NULL, NULL FROM met WHERE hs
  UNION ALL SELECT signal_id, i, 5, bts, 'H1_TOUCHED', 'H1_REACHED', t1, NULL, NULL, NULL FROM met WHERE hi >= 1 AND hi0 < 1
  UNION ALL SELECT signal_id, i, 6, bts, 'STOP_TIGHTENED', 'PROGRESSING', act1, NULL, NULL, '{lifecycle.BREAKEVEN_RULE}' FROM met WHERE hi >= 1 AND hi0 < 1 AND act1 > act0
  UNION ALL SELECT signal_id, i, 7, bts, 'H2_TOUCHED', 'H2_REACHED', t2, NULL, NULL, NULL FROM met WHERE hi >= 2 AND hi0 < 2
  UNION ALL SELECT signal_id, i, 8, bts, 'H3_TOUCHED', 'H3_REACHED', t3, NULL, NULL, NULL FROM met WHERE hi >= 3 AND hi0 < 3
  UNION ALL SELECT signal_id, i, 9, bts, 'STOP_TIGHTENED', 'PROGRESSING', act, NULL, NULL, '{lifecycle.TRAIL_RULE}' FROM met WHERE goes AND act > act1
  UNION ALL SELECT signal_id, i, 10, bts, 'TRADE_STALLED', 'STALLED', NULL, NULL, NULL, NULL FROM met WHERE stall
  UNION ALL SELECT signal_id, i, 11, bts, 'POSITION_ACTIVE', 'ACTIVE', NULL, NULL, NULL, NULL FROM met WHERE calm
  UNION ALL SELECT signal_id, i, 12, nts, 'EXIT_FILLED_NEXT_OPEN', lv, no, CASE lv WHEN 'TIME_EXIT' THEN '{lifecycle.EXIT_REASONS["TIME_EXIT"]}' ELSE '{lifecycle.EXIT_REASONS["THESIS_INVALIDATED"]}' END, NULL, NULL FROM met WHERE cl),
elog AS MATERIALIZED (SELECT signal_id, row_number() OVER w AS sequence, event_time, event_type, lag(state_to, 1, 'DETECTED') OVER w AS state_from, state_to, round(price, 4) AS price, reason, zone_touched, rule
  FROM said WINDOW w AS (PARTITION BY signal_id ORDER BY i, k)),
ver AS MATERIALIZED (SELECT signal_id, from_sequence, row_number() OVER w AS version, lead(from_sequence) OVER w AS to_sequence, effective_at, reason, round(stop, 4) AS stop FROM (
    SELECT signal_id, 1::BIGINT AS from_sequence, ts AS effective_at, 'SIGNAL_PLAN' AS reason, stop FROM sig WHERE zone_low IS NOT NULL AND ts <= {NOW_SQL} - INTERVAL 15 MINUTE
    UNION ALL SELECT signal_id, sequence, event_time, rule, price FROM elog WHERE event_type = 'STOP_TIGHTENED') WINDOW w AS (PARTITION BY signal_id ORDER BY from_sequence))
"""
LOG = SIGNALS + WALK_SQL + STEPS
_ACTION = "CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lifecycle.ACTIONS.items()) + " ELSE 'BEKLE' END"
EARLY_SQL = "TIMESTAMP '2024-01-15 12:00:00'"

ORACLES: dict[str, str] = {
    "st06_lifecycle_events": LOG + "SELECT signal_id, sequence::INT AS sequence, event_time, event_type, state_from, state_to, price, reason, zone_touched, rule FROM elog",
    "st06_plan_versions": LOG + "SELECT signal_id, version::INT AS version, from_sequence::INT AS from_sequence, to_sequence::INT AS to_sequence, effective_at, reason, stop FROM ver",
    "st06_lifecycle": LOG + f""",
ends AS (SELECT symbol, max(n) AS last FROM num WHERE ts <= {NOW_SQL} - INTERVAL 15 MINUTE GROUP BY 1),
told AS (SELECT signal_id, arg_max(state_to, sequence) AS state, max(CASE WHEN event_type = 'ENTRY_FILLED_NEXT_OPEN' THEN sequence - 1 END) AS bars_to_entry,
    arg_max(coalesce(reason, event_type), sequence) AS action_reason FROM elog GROUP BY 1),
seen AS (SELECT h.signal_id, max(CASE WHEN h.i = coalesce(pp.p, last_i) THEN health END) AS health FROM hl h LEFT JOIN pp ON pp.signal_id = h.signal_id
  JOIN (SELECT signal_id, max(i) AS last_i FROM hl GROUP BY 1) m ON m.signal_id = h.signal_id GROUP BY 1)
SELECT t.signal_id, state, outcome, coalesce(health, 'GÜÇLÜ') AS health, {_ACTION} AS action, action_reason, ets AS entry_time, xts AS exit_time, hi AS highest_target, bars_to_entry::INT AS bars_to_entry,
  CASE WHEN f.ei IS NULL THEN 0 ELSE ends.last - s.n - f.ei + 1 END AS bars_in_trade, round(entry, 4) AS entry_price, CASE WHEN entry IS NOT NULL THEN round(act, 4) END AS active_stop, round(xp, 4) AS exit_price,
  round(mfe, 4) AS mfe_r, round(mae, 4) AS mae_r, round(rr, 4) AS realized_r, round(rr - 0.002, 4) AS realized_r_after_cost
FROM told t JOIN fin f ON f.signal_id = t.signal_id JOIN sig s ON s.signal_id = t.signal_id JOIN ends ON ends.symbol = s.symbol LEFT JOIN seen ON seen.signal_id = t.signal_id""",
    "st07_event_sync": LOG + f""",
closed AS (SELECT signal_id FROM elog GROUP BY 1 HAVING max(CASE WHEN event_time <= {EARLY_SQL} - INTERVAL 15 MINUTE AND state_to IN
  ('CHASED', 'NO_ENTRY', 'EXPIRED', 'CANCELLED_DECAY', 'CANCELLED_STRUCTURE', 'HARD_STOP', 'TRAILING_STOP', 'TIME_EXIT', 'THESIS_INVALIDATED', 'H3_REACHED') THEN 1 ELSE 0 END) = 1)
SELECT event_type, count(*) AS events FROM elog WHERE event_time > {EARLY_SQL} - INTERVAL 15 MINUTE AND signal_id NOT IN (SELECT signal_id FROM closed) GROUP BY 1""",
    "st08_newest_setup": LOG + """
SELECT q.symbol, e.signal_id, e.sequence::INT AS sequence, event_time, event_type, state_from, state_to, e.reason, zone_touched, v.version::INT AS plan_version, v.stop AS plan_stop, v.reason AS plan_reason
FROM elog e JOIN (SELECT symbol, arg_max(signal_id, (ts, signal_id)) AS signal_id FROM sig WHERE zone_low IS NOT NULL AND ts <= """ + NOW_SQL + """ - INTERVAL 15 MINUTE GROUP BY 1) q ON q.signal_id = e.signal_id
JOIN ver v ON v.signal_id = e.signal_id AND e.sequence >= v.from_sequence AND (v.to_sequence IS NULL OR e.sequence < v.to_sequence)""",
}


def st06_plan_versions(spark: SparkSession, folder: str) -> DataFrame:
    _, log = lifecycle_tables(spark, folder)
    known = log.select("signal_id").distinct()
    versions = lifecycle.plan_versions(data.planned_signals(spark, folder).join(known, "signal_id", "left_semi"), log)
    return versions.select("signal_id", "version", "from_sequence", "to_sequence", "effective_at", "reason", r("stop", 4).alias("stop"))


def st08_newest_setup(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each symbol's newest setup with the plan version in force at each."""
    setups, log = lifecycle_tables(spark, folder)
    newest = lifecycle.newest_setup(setups, log)
    versions = lifecycle.plan_versions(data.planned_signals(spark, folder).join(newest.select("signal_id").distinct(), "signal_id", "left_semi"), newest)
    why = versions.select("signal_id", F.col("version").alias("plan_version"), F.col("reason").alias("plan_reason"))
    return lifecycle.with_plan_in_force(newest, versions).join(why, ["signal_id", "plan_version"]).select(
        "symbol", "signal_id", "sequence", "event_time", "event_type", "state_from", "state_to",
        F.when(F.col("reason").isNotNull(), F.concat_ws("|", "reason")).alias("reason"), "zone_touched",
        "plan_version", r("plan_stop", 4).alias("plan_stop"), "plan_reason",
    )


def st06_stream_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Events written by a stream of bars in five parts, beside those of the batch run, and the most bars that a batch kept."""
    out = scratch(spark, "stream-lifecycle")
    bars = completed(context_rows(spark, folder), now()).select("symbol", "ts", "bar_no", "open", "high", "low", "close", "volume",
                                              "ctx_momentum", "ctx_rvol", "ctx_atr", "ctx_ema20", "ctx_vwap")
    signals = data.planned_signals(spark, folder)
    sink = stream_lifecycle.advance_setups(lambda: signals, f"{out}/store")
    _feed(_by_time(bars, 5), f"{out}/in", lambda arriving: arriving.writeStream.foreachBatch(
        sink).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start())
    streamed = spark.read.parquet(f"{out}/store/events").groupBy("event_type").agg(F.count(F.lit(1)).alias("streamed"))
    _, events = lifecycle_tables(spark, folder)
    batch = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("batch"))
    kept = spark.read.parquet(f"{out}/store/open_bars").groupBy("batch_id", "symbol").count()
    bounded = kept.agg(F.coalesce(F.max("count") <= MOST_OPEN_BARS, F.lit(True)).alias("state_is_bounded"))
    return streamed.join(batch, "event_type", "full_outer").crossJoin(F.broadcast(bounded))


#: Bars after a signal that can still belong to its setup.
MOST_OPEN_BARS = lifecycle.Policy().entry_bars + lifecycle.Policy().max_holding + 1
ORACLES["st06_stream_lifecycle"] = LOG + "SELECT event_type, count(*) AS streamed, count(*) AS batch, true AS state_is_bounded FROM elog GROUP BY 1"
QUERIES |= {"st06_stream_lifecycle": st06_stream_lifecycle, "st06_plan_versions": st06_plan_versions, "st08_newest_setup": st08_newest_setup}
