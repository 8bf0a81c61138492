"""Forward label queries on the scored 15-minute signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import labels
from barloom.plans import datasets as data
from barloom.plans.common import r
from barloom.plans.features import INTRADAY
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


def signals_sql(min_score: int = 60) -> str:
    """CTE chain ending in ``sig`` (planned signals) for the oracle."""
    return INTRADAY + f""",
pl0 AS (SELECT *, price * (1 + breakout_distance / 100) AS bo FROM snap WHERE radar_score >= {min_score}),
pl1 AS (SELECT *, bo - atr * 0.25 AS zl, bo + atr * 0.10 AS zh, (bo - atr * 0.25 + (bo + atr * 0.10)) / 2 AS en FROM pl0),
pl2 AS (SELECT *, CASE WHEN price > 0 AND en > 0 AND atr > 0 AND low10 > 0 AND least(low10, en - atr * 1.2) > 0 AND least(low10, en - atr * 1.2) < en
    THEN round_even(least(low10, en - atr * 1.2), 2) END AS st FROM pl1),
pl3 AS (SELECT *, CASE WHEN st > 0 AND en - st > 0 AND (en - st) / en * 100 >= 0.10
    THEN least(floor(100000.0 * 0.75 / 100 / (en - st)), floor(100000.0 * 20 / 100 / en)) END AS qty FROM pl2),
sig AS MATERIALIZED (SELECT *,
    CASE WHEN qty IS NULL OR price <= st THEN 'GECERSIZ' WHEN price > zh + atr * 0.5 THEN 'KACMIS_KOVALAMA' WHEN price >= bo THEN 'BREAKOUT_ONAYI'
      WHEN price BETWEEN zl AND zh THEN 'GIRIS_BOLGESINDE' ELSE 'GIRIS_BEKLENIYOR' END AS plan_status,
    CASE WHEN qty IS NOT NULL THEN round_even(zl, 2) END AS zone_low, CASE WHEN qty IS NOT NULL THEN round_even(zh, 2) END AS zone_high,
    CASE WHEN qty IS NOT NULL THEN st END AS stop, CASE WHEN qty IS NOT NULL THEN round_even(en + (en - st) * 1.5, 2) END AS t1,
    CASE WHEN qty IS NOT NULL THEN round_even(en + (en - st) * 2.5, 2) END AS t2, CASE WHEN qty IS NOT NULL THEN round_even(en + (en - st) * 3, 2) END AS t3
  FROM pl3)"""


OUTCOME_SQL = f""",
nxt AS (SELECT signal_id, s.price, s.stop, s.ts AS sts, b.n - s.n AS i, b.ts AS bts, b.open, b.high, b.low, b.close
  FROM sig s JOIN num b ON b.symbol = s.symbol AND b.n > s.n WHERE b.ts <= {NOW_SQL} - INTERVAL 15 MINUTE),
hz AS (SELECT * FROM (VALUES ('15m', 1), ('30m', 2), ('60m', 4), ('120m', 8)) t(horizon, bars)),
near AS (SELECT signal_id, horizon, bars, price, stop, i, high, low, close, NULL::DATE AS label_day FROM nxt, hz WHERE i <= bars),
sdays AS (SELECT signal_id, min(d) FILTER (WHERE d > sd) AS nd FROM (SELECT signal_id, CAST(sts + INTERVAL 3 HOUR AS DATE) AS sd, CAST(bts + INTERVAL 3 HOUR AS DATE) AS d FROM nxt) GROUP BY 1),
far AS (SELECT n.signal_id, horizon, 1 AS bars, price, stop, i, high, low, close, ld AS label_day FROM nxt n JOIN (
    SELECT signal_id, 'EOD' AS horizon, CAST(ts + INTERVAL 3 HOUR AS DATE) AS ld FROM sig UNION ALL SELECT signal_id, 'NEXT_DAY', nd FROM sdays) d
  ON d.signal_id = n.signal_id AND CAST(n.bts + INTERVAL 3 HOUR AS DATE) = ld),
agg AS (SELECT signal_id, horizon, bars, max(label_day) AS label_day, count(*) AS k, arg_max(close, i) / any_value(price) - 1 AS fr, max(high) / any_value(price) - 1 AS mfe,
    min(low) / any_value(price) - 1 AS mae, any_value(stop) AS stop, min(i) FILTER (WHERE low <= stop) AS si, min(i) FILTER (WHERE high >= price * 1.01) AS ti
  FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY 1, 2, 3),
frame AS (SELECT signal_id, horizon, bars FROM sig, (SELECT * FROM hz UNION ALL VALUES ('EOD', 1), ('NEXT_DAY', 1)) h),
outc AS MATERIALIZED (SELECT f.signal_id, f.horizon, coalesce(k >= f.bars AND (label_day IS NULL OR CAST({NOW_SQL} + INTERVAL 3 HOUR AS DATE) > label_day
      OR (CAST({NOW_SQL} + INTERVAL 3 HOUR AS DATE) = label_day AND hour({NOW_SQL} + INTERVAL 3 HOUR) >= 18)), false) AS ok, fr, mfe, mae, stop, si, ti
  FROM frame f LEFT JOIN agg USING (signal_id, horizon, bars)),
outcomes AS MATERIALIZED (SELECT signal_id, horizon, CASE WHEN ok THEN 'LABEL_AVAILABLE' ELSE 'LABEL_PENDING' END AS status, CASE WHEN ok THEN fr END AS forward_return,
    CASE WHEN ok THEN mfe END AS maximum_favorable_excursion, CASE WHEN ok THEN mae END AS maximum_adverse_excursion,
    CASE WHEN ok THEN mfe >= 0.01 END AS hit_plus_1_percent, CASE WHEN ok THEN mfe >= 0.02 END AS hit_plus_2_percent,
    CASE WHEN ok THEN mfe >= 0.03 END AS hit_plus_3_percent, CASE WHEN ok THEN mfe >= 0.05 END AS hit_plus_5_percent,
    CASE WHEN ok AND stop IS NOT NULL THEN si IS NOT NULL AND (ti IS NULL OR si <= ti) END AS hit_stop_first FROM outc)"""

AUDIT_SQL = """,
abars AS (SELECT s.signal_id, s.zone_low, s.zone_high, s.stop, s.t1, s.t2, s.t3, b.n - s.n AS i, b.ts AS bts, b.open, b.high, b.low
  FROM sig s JOIN num b ON b.symbol = s.symbol AND b.n > s.n AND b.n <= s.n + 23),
ent AS (SELECT *, min(CASE WHEN i <= 8 AND low <= zone_high AND high >= zone_low THEN i END) OVER (PARTITION BY signal_id) AS ei FROM abars),
mg AS (SELECT *, coalesce(i >= ei AND i < ei + 16, false) AS m FROM ent),
ag AS (SELECT signal_id, any_value(ei) AS ei, count(*) FILTER (WHERE i <= 8) AS seen, max(bts) FILTER (WHERE i <= 8) AS wend,
    max(bts) FILTER (WHERE i = ei) AS entry_at, max(open) FILTER (WHERE i = ei) AS eopen, count(*) FILTER (WHERE m) AS managed, max(bts) FILTER (WHERE m) AS mend,
    min(i) FILTER (WHERE m AND low <= stop) AS s, min(bts) FILTER (WHERE m AND low <= stop) AS sts, min(i) FILTER (WHERE m AND high >= t1) AS h1, min(bts) FILTER (WHERE m AND high >= t1) AS h1ts,
    min(i) FILTER (WHERE m AND high >= t2) AS h2, min(bts) FILTER (WHERE m AND high >= t2) AS h2ts, min(i) FILTER (WHERE m AND high >= t3) AS h3, min(bts) FILTER (WHERE m AND high >= t3) AS h3ts
  FROM mg GROUP BY 1),
au0 AS (SELECT sig.signal_id, sig.zone_low, sig.zone_high, ag.* EXCLUDE (signal_id), coalesce(s IS NOT NULL AND (h3 IS NULL OR s <= h3), false) AS stopped FROM sig LEFT JOIN ag USING (signal_id)),
au1 AS (SELECT *, CASE WHEN stopped THEN s WHEN h3 IS NOT NULL THEN h3 + 1 ELSE 10000 END AS cut FROM au0),
au2 AS (SELECT *, CASE WHEN h1 < cut THEN h1ts END AS target1_hit_at, CASE WHEN h2 < cut THEN h2ts END AS target2_hit_at, CASE WHEN h3 < cut THEN h3ts END AS target3_hit_at FROM au1),
au3 AS (SELECT *, CASE WHEN target3_hit_at IS NOT NULL THEN 3 WHEN target2_hit_at IS NOT NULL THEN 2 WHEN target1_hit_at IS NOT NULL THEN 1 ELSE 0 END AS highest_target FROM au2),
audits AS MATERIALIZED (SELECT signal_id, 2 AS audit_version, entry_at AS entry_hit_at, CASE WHEN ei IS NOT NULL THEN least(greatest(eopen, zone_low), zone_high) END AS entry_price,
    CASE WHEN stopped THEN sts END AS stop_hit_at, target1_hit_at, target2_hit_at, target3_hit_at,
    CASE WHEN zone_low IS NULL OR ei IS NULL THEN 'NONE' WHEN stopped AND highest_target = 0 THEN 'STOP_FIRST' WHEN stopped THEN 'H' || highest_target || '_THEN_STOP'
      WHEN highest_target > 0 THEN 'TARGET1_FIRST' ELSE 'NONE' END AS ordering,
    CASE WHEN zone_low IS NULL THEN 'PLAN_UNAVAILABLE' WHEN ei IS NULL THEN CASE WHEN seen >= 8 THEN 'NO_ENTRY' ELSE 'WAITING_ENTRY' END WHEN stopped THEN 'STOPPED'
      WHEN highest_target = 3 THEN 'H3_REACHED' WHEN managed >= 16 THEN 'EXPIRED_H' || highest_target WHEN highest_target > 0 THEN 'H' || highest_target || '_ACTIVE' ELSE 'ENTRY_ACTIVE' END AS result_classification,
    highest_target, ei AS bars_to_entry, CASE WHEN ei IS NULL THEN 0 ELSE managed END AS bars_after_entry,
    CASE WHEN zone_low IS NULL THEN NULL WHEN ei IS NULL THEN CASE WHEN seen >= 8 THEN wend END WHEN stopped THEN sts WHEN highest_target = 3 THEN target3_hit_at WHEN managed >= 16 THEN mend END AS terminal_at
  FROM au3)"""

SIGNALS = signals_sql()
LABELS = SIGNALS + OUTCOME_SQL
AUDITS = SIGNALS + AUDIT_SQL
BOTH = SIGNALS + OUTCOME_SQL + AUDIT_SQL


def outcome_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("outcomes", spark, folder, lambda: labels.label_all(
        data.planned_signals(spark, folder), tables.m15_bars(spark, folder), now()))


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("audits", spark, folder, lambda: labels.level_audit(
        data.planned_signals(spark, folder), tables.m15_bars(spark, folder)))


_RATES = ("forward_return", "maximum_favorable_excursion", "maximum_adverse_excursion")
_FLAGS = tuple(f"hit_plus_{p}_percent" for p in labels.HIT_PERCENTS) + ("hit_stop_first",)
_OUT_SQL = "SELECT signal_id, horizon, status, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + ", " + ", ".join(_FLAGS) + " FROM outcomes"


def _out(frame: DataFrame) -> DataFrame:
    return frame.select("signal_id", "horizon", "status", *[r(c).alias(c) for c in _RATES], *_FLAGS)


@query("l01_l03_labels", LABELS + _OUT_SQL + " WHERE horizon NOT IN ('EOD', 'NEXT_DAY')")
def l01(spark: SparkSession, folder: str) -> DataFrame:
    return _out(labels.label_bars(data.planned_signals(spark, folder), tables.m15_bars(spark, folder), now()))


@query("l02_day_labels", LABELS + _OUT_SQL + " WHERE horizon IN ('EOD', 'NEXT_DAY')")
def l02(spark: SparkSession, folder: str) -> DataFrame:
    return _out(labels.label_days(data.planned_signals(spark, folder), tables.m15_bars(spark, folder), now()))


@query("l04_stop_first", LABELS + """
SELECT horizon, hit_stop_first, count(*) AS signals FROM outcomes WHERE status = 'LABEL_AVAILABLE' GROUP BY 1, 2""")
def l04(spark: SparkSession, folder: str) -> DataFrame:
    rows = outcome_rows(spark, folder).filter(F.col("status") == "LABEL_AVAILABLE")
    return rows.groupBy("horizon", "hit_stop_first").agg(F.count(F.lit(1)).alias("signals"))


LIFECYCLE_SQL = """SELECT signal_id, CASE WHEN bool_and(status <> 'LABEL_PENDING') THEN 'FULLY_LABELED'
  WHEN bool_or(status = 'LABEL_AVAILABLE') THEN 'PARTIALLY_LABELED' ELSE 'OUTCOME_PENDING' END AS lifecycle FROM outcomes GROUP BY 1"""


@query("l05_label_lifecycle", LABELS + LIFECYCLE_SQL)
def l05(spark: SparkSession, folder: str) -> DataFrame:
    return labels.lifecycle(outcome_rows(spark, folder))


AUDIT_COLUMNS = (
    "signal_id", "audit_version", "entry_hit_at", "entry_price", "stop_hit_at", "target1_hit_at", "target2_hit_at",
    "target3_hit_at", "ordering", "result_classification", "highest_target", "bars_to_entry", "bars_after_entry", "terminal_at",
)
_AUDIT_PICK = "SELECT " + ", ".join("round(entry_price, 6) AS entry_price" if c == "entry_price" else c for c in AUDIT_COLUMNS) + " FROM audits"


@query("l06_level_audit", AUDITS + _AUDIT_PICK)
def l06(spark: SparkSession, folder: str) -> DataFrame:
    return audit_rows(spark, folder).withColumn("entry_price", r("entry_price"))


@query("l07_upsert_outcomes", LABELS + "SELECT status, horizon, count(*) AS outcomes FROM outcomes GROUP BY 1, 2")
def l07(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of an early run are replaced by those of a later one."""
    signals, bars = data.planned_signals(spark, folder), tables.m15_bars(spark, folder)
    early = labels.label_all(signals, bars, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    merged = labels.upsert_outcomes(early, outcome_rows(spark, folder))
    return merged.groupBy("status", "horizon").agg(F.count(F.lit(1)).alias("outcomes"))


@query("l07_merge_legacy_audit", AUDITS + """
SELECT signal_id, CASE WHEN highest_target = 1 THEN NULL ELSE target1_hit_at END AS first_hit, ordering, 'LEGACY' AS result_classification FROM audits
WHERE highest_target <> 1 UNION ALL SELECT signal_id, target1_hit_at, ordering, 'LEGACY' FROM audits WHERE highest_target = 1""")
def l07_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """Stored audits that lost their hits get them back from a legacy audit; nothing else changes."""
    audits = audit_rows(spark, folder)
    one = F.col("highest_target") == 1
    stored = audits.withColumns({
        "target1_hit_at": F.when(~one, F.col("target1_hit_at")),
        "ordering": F.when(~one, F.col("ordering")).otherwise("NONE"),
    })
    fresh = audits.withColumn("result_classification", F.lit("LEGACY"))
    merged = labels.merge_audits(stored, fresh, versioned=False)
    return merged.select("signal_id", F.col("target1_hit_at").alias("first_hit"), "ordering", "result_classification")


@query("l08_outcome_update", BOTH + """, lc AS (""" + LIFECYCLE_SQL + """)
SELECT s.symbol, lc.lifecycle, a.result_classification, count(*) AS signals FROM sig s JOIN lc USING (signal_id) JOIN audits a USING (signal_id) GROUP BY 1, 2, 3""")
def l08(spark: SparkSession, folder: str) -> DataFrame:
    """All signals with bars relabelled at once."""
    signals = data.planned_signals(spark, folder).select("signal_id", "symbol")
    state = labels.lifecycle(outcome_rows(spark, folder))
    joined = signals.join(state, "signal_id").join(audit_rows(spark, folder), "signal_id")
    return joined.groupBy("symbol", "lifecycle", "result_classification").agg(F.count(F.lit(1)).alias("signals"))
