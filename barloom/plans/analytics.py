"""Join and aggregate queries over signals, outcomes and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import analytics, labels, ranking
from barloom.plans import datasets as data
from barloom.plans.common import r
from barloom.plans.features import CLASS_CASE
from barloom.plans.labels import BOTH, LABELS, LIFECYCLE_SQL, audit_rows, outcome_rows
from barloom.staging import staged

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def record_rows(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        outcomes = outcome_rows(spark, folder)
        return analytics.signal_records(
            data.planned_signals(spark, folder).drop("plan", "zone_low", "zone_high", "stop", "t1", "t2", "t3"),
            outcomes, audit_rows(spark, folder), labels.lifecycle(outcomes))
    return staged("records", spark, folder, build)


RECORDS = BOTH + ", lc AS (" + LIFECYCLE_SQL + f"""),
recs AS MATERIALIZED (SELECT s.signal_id, s.symbol, s.ts, s.price, s.radar_score, {CLASS_CASE.replace('radar_score', 's.radar_score')} AS classification, s.rvol, s.early_momentum_score, lc.lifecycle,
    a.* EXCLUDE (signal_id), CASE WHEN s.radar_score >= 90 THEN '90+' WHEN s.radar_score >= 80 THEN '80-89' ELSE '70-79' END AS score_bucket,
    o.status AS st120, o.maximum_favorable_excursion AS mfe, o.maximum_adverse_excursion AS mae
  FROM sig s JOIN lc ON lc.signal_id = s.signal_id LEFT JOIN audits a ON a.signal_id = s.signal_id LEFT JOIN outcomes o ON o.signal_id = s.signal_id AND o.horizon = '120m')"""


def _minutes(column: str) -> str:
    return f"round_even(date_diff('millisecond', ts, {column}) / 60000.0, 0)::BIGINT AS {column.replace('_at', '_minutes')}"


# --- joins ----------------------------------------------------------------------------------

@query("j01_signals_with_audit", RECORDS + """
SELECT signal_id, ts, result_classification FROM recs WHERE audit_version = 2 AND result_classification IN ('NO_ENTRY', 'STOPPED', 'H3_REACHED', 'EXPIRED_H0', 'EXPIRED_H1', 'EXPIRED_H2')""")
def j01(spark: SparkSession, folder: str) -> DataFrame:
    audits = audit_rows(spark, folder).filter((F.col("audit_version") == 2) & F.col("result_classification").isin(*analytics.TERMINAL_RESULTS))
    return data.planned_signals(spark, folder).select("signal_id", "ts").join(audits, "signal_id").select("signal_id", "ts", "result_classification").orderBy("ts", "signal_id")


@query("j02_outcomes_with_features", LABELS + """
SELECT o.signal_id, o.horizon, o.status, s.radar_score, round(s.price, 6) AS price FROM outcomes o LEFT JOIN (SELECT * FROM sig WHERE radar_score >= 70) s ON s.signal_id = o.signal_id""")
def j02(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes keep their row when the signal's features are missing (score below 70)."""
    known = data.planned_signals(spark, folder).filter(F.col("radar_score") >= 70).select("signal_id", "radar_score", r("price").alias("price"))
    return outcome_rows(spark, folder).select("signal_id", "horizon", "status").join(known, "signal_id", "left")


@query("j03_signal_records", RECORDS + "SELECT signal_id, score_bucket, lifecycle, ordering, result_classification, highest_target, st120, round(mfe, 6) AS mfe120 FROM recs")
def j03(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("outcomes")["120m"]
    return record_rows(spark, folder).select(
        "signal_id", "score_bucket", "lifecycle", "ordering", "result_classification", "highest_target",
        label["status"].alias("st120"), r(label["maximum_favorable_excursion"]).alias("mfe120"))


@query("f18_minutes_to_events", RECORDS + "SELECT signal_id, " + ", ".join(_minutes(c) for c in analytics.HITS) + " FROM recs")
def f18(spark: SparkSession, folder: str) -> DataFrame:
    return record_rows(spark, folder).select("signal_id", *[c.replace("_at", "_minutes") for c in analytics.HITS])


@query("j05_member_flag", RECORDS + """
SELECT signal_id, symbol IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) % 2 = 0) AS member FROM recs""")
def j05(spark: SparkSession, folder: str) -> DataFrame:
    from barloom.sources import tables

    members = tables.table(spark, folder, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.count(F.lit(1)) % 2 == 0).alias("active"))
    return ranking.flag_members(record_rows(spark, folder), members).select("signal_id", "member")


@query("j06_unlabelled_signals", RECORDS + """
SELECT signal_id FROM sig WHERE signal_id NOT IN (SELECT signal_id FROM outcomes WHERE horizon = 'NEXT_DAY' AND status = 'LABEL_AVAILABLE')""")
def j06(spark: SparkSession, folder: str) -> DataFrame:
    done = outcome_rows(spark, folder).filter((F.col("horizon") == "NEXT_DAY") & (F.col("status") == "LABEL_AVAILABLE"))
    return data.planned_signals(spark, folder).select("signal_id").join(done, "signal_id", "left_anti")


# --- aggregates -----------------------------------------------------------------------------

@query("a04_daily_summary", RECORDS + """
SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS date, count(*) AS total, count_if(classification = 'VERY_STRONG_CANDIDATE') AS very_strong, count_if(classification = 'STRONG_CANDIDATE') AS strong,
  count_if(classification = 'CANDIDATE') AS candidate, count_if(lifecycle = 'FULLY_LABELED') AS completed, count_if(lifecycle = 'OUTCOME_PENDING') AS pending, count_if(lifecycle = 'PARTIALLY_LABELED') AS partial,
  count(target1_hit_at) AS h1_hits, count(target2_hit_at) AS h2_hits, count(target3_hit_at) AS h3_hits, count(entry_hit_at) AS entered, count_if(result_classification = 'NO_ENTRY') AS no_entry,
  count_if(result_classification = 'STOPPED') AS stopped FROM recs GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def a04(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.daily_summary(record_rows(spark, folder))


def _buckets_sql(key: str) -> str:
    return RECORDS + f"""
SELECT {key} AS bucket, count(*) AS unique_signals, count_if(st120 = 'LABEL_AVAILABLE') AS mature_signals,
  round(avg((target1_hit_at IS NOT NULL)::INT) FILTER (WHERE st120 = 'LABEL_AVAILABLE'), 6) AS h1_hit_rate, round(avg((target2_hit_at IS NOT NULL)::INT) FILTER (WHERE st120 = 'LABEL_AVAILABLE'), 6) AS h2_hit_rate,
  round(avg((target3_hit_at IS NOT NULL)::INT) FILTER (WHERE st120 = 'LABEL_AVAILABLE'), 6) AS h3_hit_rate, round(avg((ordering = 'STOP_FIRST')::INT) FILTER (WHERE st120 = 'LABEL_AVAILABLE'), 6) AS stop_first_rate,
  round(avg(mfe), 6) AS average_mfe, round(median(mfe), 6) AS median_mfe, round(avg(mae), 6) AS average_mae, round(median(mae), 6) AS median_mae FROM recs GROUP BY 1"""


_RVOL = "CASE WHEN rvol < 1 THEN '<1' WHEN rvol < 2 THEN '1-2' WHEN rvol < 3 THEN '2-3' WHEN rvol < 5 THEN '3-5' ELSE '5+' END"
_MOMENTUM = "CASE WHEN early_momentum_score < 60 THEN '<60' WHEN early_momentum_score < 80 THEN '60-79' WHEN early_momentum_score < 90 THEN '80-89' ELSE '90+' END"


def _bucketed(group: str) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = analytics.bucket_analytics(record_rows(spark, folder), group)
        return out.select("bucket", "unique_signals", "mature_signals", *[r(c).alias(c) for c in (
            "h1_hit_rate", "h2_hit_rate", "h3_hit_rate", "stop_first_rate", "average_mfe", "median_mfe", "average_mae", "median_mae")])
    return run


for _name, _group, _key in (("a05_bucket_analytics", "score", "score_bucket"), ("a05_rvol_analytics", "rvol", _RVOL), ("a05_momentum_analytics", "momentum", _MOMENTUM)):
    query(_name, _buckets_sql(_key))(_bucketed(_group))


def _accuracy_sql(key: str) -> str:
    return RECORDS + f"""
SELECT {key} AS bucket, count(*) AS signals, count(hit_plus_1_percent) AS labeled, round(avg(hit_plus_1_percent::INT), 6) AS plus_1_hit_rate,
  round(avg(maximum_favorable_excursion), 6) AS average_mfe, round(avg(maximum_adverse_excursion), 6) AS average_mae
FROM (SELECT recs.*, o.horizon, o.hit_plus_1_percent, o.maximum_favorable_excursion, o.maximum_adverse_excursion FROM recs JOIN outcomes o USING (signal_id)) j WHERE horizon = '60m' GROUP BY 1"""


def _accuracy(group: str) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        signals = data.planned_signals(spark, folder).select("signal_id", "symbol", "radar_score", "rvol")
        rows = outcome_rows(spark, folder).filter(F.col("horizon") == "60m").join(signals, "signal_id")
        out = analytics.accuracy_buckets(rows, group)
        return out.select("bucket", "signals", "labeled", *[r(c).alias(c) for c in ("plus_1_hit_rate", "average_mfe", "average_mae")])
    return run


for _name, _group, _key in (("a06_accuracy_by_score", "score", "score_bucket"),
                            ("a06_accuracy_by_rvol", "rvol", "CASE WHEN rvol >= 2 THEN '2+' WHEN rvol >= 1.5 THEN '1.5-2' ELSE '<1.5' END"),
                            ("a06_accuracy_by_symbol", "symbol", "symbol")):
    query(_name, _accuracy_sql(_key))(_accuracy(_group))

_HZ = ("15m", "30m", "60m", "120m", "EOD", "NEXT_DAY")


@query("a07_outcome_summary", LABELS + "SELECT signal_id, " + ", ".join(
    f"round(max(forward_return) FILTER (WHERE horizon = '{h}'), 6) AS forward_return_{h.lower()}" for h in _HZ) + """,
  round(max(maximum_favorable_excursion), 6) AS maximum_favorable_excursion, round(min(maximum_adverse_excursion), 6) AS maximum_adverse_excursion FROM outcomes GROUP BY 1""")
def a07(spark: SparkSession, folder: str) -> DataFrame:
    out = analytics.outcome_summary(outcome_rows(spark, folder))
    return out.select("signal_id", *[r(c).alias(c) for c in out.columns if c != "signal_id"])


@query("a08_shadow_status", RECORDS + """,
e AS (SELECT count(*) AS k FROM recs WHERE result_classification IN ('NO_ENTRY', 'STOPPED', 'H3_REACHED', 'EXPIRED_H0', 'EXPIRED_H1', 'EXPIRED_H2'))
SELECT count(*) AS observations, count_if(lifecycle = 'FULLY_LABELED') AS labeled, any_value(k) AS training_eligible, count(*) - any_value(k) AS excluded,
  least(100.0, round_even(any_value(k) / 200 * 100, 1)) AS progress_percent, greatest(0, 200 - any_value(k)) AS remaining, CASE WHEN any_value(k) >= 200 THEN 'EĞİTİM_BEKLİYOR' ELSE 'VERİ_TOPLANIYOR' END AS status FROM recs, e""")
def a08(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.shadow_status(data.planned_signals(spark, folder), labels.lifecycle(outcome_rows(spark, folder)), audit_rows(spark, folder))


@query("a09_lifecycle_counts", RECORDS + """
SELECT count(*) AS observations, count_if(lifecycle = 'FULLY_LABELED') AS fully_labeled, count_if(lifecycle <> 'FULLY_LABELED') AS pending FROM recs""")
def a09(spark: SparkSession, folder: str) -> DataFrame:
    return labels.lifecycle(outcome_rows(spark, folder)).agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("lifecycle") == "FULLY_LABELED").alias("fully_labeled"),
        F.count_if(F.col("lifecycle") != "FULLY_LABELED").alias("pending"))


@query("a19_class_counts", RECORDS + """
SELECT c AS classification, (SELECT count(*) FROM recs WHERE classification = c AND price < 101) AS candidates
FROM (VALUES ('VERY_STRONG_CANDIDATE'), ('STRONG_CANDIDATE'), ('CANDIDATE'), ('WATCH')) t(c)""")
def a19(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.class_counts(record_rows(spark, folder).filter(F.col("price") < 101))
