"""Learning and evaluation queries on signals with terminal audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import learning
from barloom.plans import datasets as data
from barloom.plans.common import r
from barloom.plans.labels import AUDITS, audit_rows
from barloom.staging import hold, staged

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged("training", spark, folder, lambda: learning.training_rows(data.planned_signals(spark, folder), audit_rows(spark, folder)))


_VECTOR = ", ".join(
    {"relative_strength": "0.0 AS relative_strength", "data_quality": "100.0 AS data_quality"}.get(f, f"coalesce(s.{f}, 0) AS {f}") for f in learning.FEATURES)
TRAIN = AUDITS + f""",
tr AS MATERIALIZED (SELECT s.signal_id, s.ts, {_VECTOR}, (entry_hit_at IS NOT NULL)::INT AS entry, (result_classification = 'STOPPED')::INT AS stop, (highest_target >= 1)::INT AS h1, (highest_target >= 2)::INT AS h2,
    (highest_target >= 3)::INT AS h3 FROM sig s JOIN audits a ON a.signal_id = s.signal_id WHERE result_classification IN ('NO_ENTRY', 'STOPPED', 'H3_REACHED', 'EXPIRED_H0', 'EXPIRED_H1', 'EXPIRED_H2')),
hd AS (SELECT 'entry' AS head, signal_id, ts, entry AS label FROM tr UNION ALL SELECT 'stop', signal_id, ts, stop FROM tr WHERE entry = 1 UNION ALL SELECT 'h1', signal_id, ts, h1 FROM tr WHERE entry = 1
  UNION ALL SELECT 'h2', signal_id, ts, h2 FROM tr WHERE h1 = 1 UNION ALL SELECT 'h3', signal_id, ts, h3 FROM tr WHERE h2 = 1),
ps AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY ts, signal_id) - 1 AS k, count(*) OVER (PARTITION BY head) AS n FROM hd),
sp AS MATERIALIZED (SELECT *, CASE WHEN k < t - g THEN 'train' WHEN k < t THEN 'embargo' WHEN k < u - g THEN 'validation' WHEN k < u THEN 'embargo' ELSE 'test' END AS part
  FROM (SELECT *, least(16, greatest(0, least(t, u - t) - 1)) AS g FROM (SELECT *, floor(n * 0.6)::INT AS t, floor(n * 0.8)::INT AS u FROM ps)))"""


@query("m01_feature_vector", TRAIN + "SELECT signal_id, " + ", ".join(f"round({f}, 4) AS {f}" for f in learning.FEATURES) + " FROM tr")
def m01(spark: SparkSession, folder: str) -> DataFrame:
    return training_rows(spark, folder).select("signal_id", *[r(f, 4).alias(f) for f in learning.FEATURES])


@query("m02_head_labels", TRAIN + "SELECT head, label, count(*) AS samples FROM hd GROUP BY 1, 2")
def m02(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_rows(spark, folder)
    out = None
    for head in learning.HEADS:
        part = learning.head_rows(rows, head).groupBy("label").agg(F.count(F.lit(1)).alias("samples")).withColumn("head", F.lit(head))
        out = part if out is None else out.unionByName(part)
    return out


@query("m03_m04_split", TRAIN + "SELECT signal_id, part FROM sp WHERE head = 'entry'")
def m03(spark: SparkSession, folder: str) -> DataFrame:
    return learning.chronological_split(learning.head_rows(training_rows(spark, folder), "entry")).select("signal_id", "part")


SCORE_COLUMNS = (
    "roc_auc double, pr_auc double, brier_score double, log_loss double, precision double, recall double, f1 double, "
    "status string, display string, sample long, max_calibration_gap double, beats_base_rate_brier boolean, head string")


@query("m05_logistic_heads")
def m05(spark: SparkSession, folder: str) -> DataFrame:
    """Every head fitted and measured on its test part."""
    return head_scores(learning.split_heads(training_rows(spark, folder)))


def head_scores(splits: DataFrame) -> DataFrame:
    """A row for each head that can be fitted; none where no head has both classes in its training part."""
    models = learning.fit_heads(splits)
    if not models:
        return splits.sparkSession.createDataFrame([], SCORE_COLUMNS)
    out = None
    for head, model in models.items():
        test = hold(learning.predict(model, splits.filter((F.col("part") == "test") & (F.col("head") == head)), "p").select("label", "p"))
        scores = learning.classification_metrics(test).crossJoin(F.broadcast(learning.probability_quality(test)))  # one row each
        scores = scores.withColumn("head", F.lit(head))
        out = scores if out is None else out.unionByName(scores)
    return out


@query("m05_heads_are_fitted", TRAIN + """
SELECT head, count(*) AS samples, sum(label)::BIGINT AS positives, true AS gradient_vanishes FROM sp WHERE part = 'train' GROUP BY 1 HAVING min(label) < max(label)""")
def m05_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """At the fitted weights of every head the gradient of loss and penalty vanishes."""
    splits = learning.split_heads(training_rows(spark, folder))
    out = learning.gradients(learning.fit_heads(splits), splits)
    return out.select("head", "samples", "positives", (F.col("gradient") < 1e-6).alias("gradient_vanishes"))


_SCORED_FROM = "2024-01-20"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_rows(spark, folder)
    signals = data.planned_signals(spark, folder)
    done = signals.filter(F.col("ts") < F.lit(_SCORED_FROM).cast("timestamp")).select("signal_id")
    return learning.score_signals(learning.fit_heads(learning.split_heads(rows)), signals, done)


@query("m06_score_missing")
def m06(spark: SparkSession, folder: str) -> DataFrame:
    """Signals after 20 January have no prediction yet; only they are scored."""
    return _scores(spark, folder)


@query("m06_scored_signals", TRAIN + f"""
SELECT signal_id, (SELECT count(*) FROM (SELECT head FROM sp WHERE part = 'train' GROUP BY 1 HAVING min(label) < max(label)))::INT AS scored_heads FROM sig WHERE ts >= TIMESTAMP '{_SCORED_FROM}'""")
def m06_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Which signals get how many probabilities, each strictly between 0 and 1."""
    scored = _scores(spark, folder)
    heads = [c for c in scored.columns if c != "signal_id"]
    inside = sum((F.when((F.col(c) > 0) & (F.col(c) < 1), 1).otherwise(0) for c in heads), F.lit(0))
    return scored.select("signal_id", inside.cast("int").alias("scored_heads"))


@query("m07_base_rate", TRAIN + "SELECT round(avg(label), 6) AS base_rate FROM sp WHERE head = 'entry' AND part = 'train'")
def m07(spark: SparkSession, folder: str) -> DataFrame:
    split = learning.chronological_split(learning.head_rows(training_rows(spark, folder), "entry"))
    return learning.base_rate(split.filter(F.col("part") == "train")).select(r("base_rate").alias("base_rate"))


@query("m08_stump", TRAIN + """,
lg AS (SELECT label, u.k, u.feature, u.v FROM (SELECT tr.*, sp.label FROM tr JOIN sp ON sp.signal_id = tr.signal_id AND head = 'entry' AND part = 'train') t, LATERAL (VALUES """ + ", ".join(
    f"({k}, '{f}', CAST(t.{f} AS DOUBLE))" for k, f in enumerate(learning.FEATURES)) + """) u(k, feature, v)),
md AS (SELECT feature, median(v) AS m FROM lg GROUP BY 1),
ls AS (SELECT k, lg.feature, m, avg(((v >= m)::INT - label) ** 2) AS loss, avg(label) FILTER (WHERE v < m) AS lr, avg(label) FILTER (WHERE v >= m) AS rr, avg(label) AS b FROM lg JOIN md ON md.feature = lg.feature GROUP BY 1, 2, 3)
SELECT feature, round(m, 4) AS threshold, round(loss, 6) AS loss, round(coalesce(lr, b), 6) AS left_rate, round(coalesce(rr, b), 6) AS right_rate FROM ls ORDER BY ls.loss, k LIMIT 1""")
def m08(spark: SparkSession, folder: str) -> DataFrame:
    split = learning.chronological_split(learning.head_rows(training_rows(spark, folder), "entry"))
    out = learning.decision_stump(split.filter(F.col("part") == "train"))
    return out.select("feature", r("threshold", 4).alias("threshold"), *[r(c).alias(c) for c in ("loss", "left_rate", "right_rate")])


# A fixed probability makes the evaluation comparable in SQL: a logistic curve of the signal values.
_SCORED = TRAIN + """,
pr AS MATERIALIZED (SELECT sp.label, round(1 / (1 + exp(-(ema9_distance * 2 + (tr.radar_score - 70) / 8.0))), 4) AS p FROM tr JOIN sp ON sp.signal_id = tr.signal_id AND head = 'entry')"""


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    z = F.col("ema9_distance") * 2 + (F.col("radar_score") - 70) / 8.0
    return learning.head_rows(training_rows(spark, folder), "entry").select("label", F.round(1 / (1 + F.exp(-z)), 4).alias("p"))


@query("m09_classification_metrics", _SCORED + """,
pt AS (SELECT least(greatest(p, 1e-12), 1 - 1e-12) AS p, sum(label) AS pos, sum(1 - label) AS neg FROM pr GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM pt WINDOW w AS (ORDER BY p DESC)),
ar AS (SELECT sum(neg * (tp + tp - pos) / 2.0) / (sum(pos) * sum(neg)) AS roc_auc,
  sum(pos * (tp * 1.0 / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) * 1.0 / (tp - pos + fp - neg) END) / 2) / sum(pos) AS pr_auc FROM cu),
bs AS (SELECT avg((p - label) ** 2) AS brier_score, -avg(CASE WHEN label = 1 THEN ln(greatest(p, 1e-12)) ELSE ln(1 - least(p, 1 - 1e-12)) END) AS log_loss, count_if(p >= 0.5 AND label = 1) AS t, count_if(p >= 0.5 AND label = 0) AS f,
  count_if(p < 0.5 AND label = 1) AS m FROM pr)
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss, round(t * 1.0 / (t + f), 6) AS "precision", round(t * 1.0 / (t + m), 6) AS recall,
  round(2.0 * t / (2 * t + f + m), 6) AS f1 FROM ar, bs""")
def m09(spark: SparkSession, folder: str) -> DataFrame:
    out = learning.classification_metrics(scored_rows(spark, folder))
    return out.select(*[r(c).alias(c) for c in out.columns])


_BINS = "CASE " + " ".join(f"WHEN p >= {k * 0.1!r}::DOUBLE AND p < {k * 0.1 + 0.1!r}::DOUBLE THEN {k}" for k in range(10)) + " END"


@query("m10_calibration", _SCORED + f"""
SELECT b AS bin, count(*) AS count, round(avg(p), 6) AS mean_probability, round(avg(label), 6) AS hit_rate FROM (SELECT *, {_BINS} AS b FROM pr) WHERE b IS NOT NULL GROUP BY 1""")
def m10(spark: SparkSession, folder: str) -> DataFrame:
    out = learning.calibration(scored_rows(spark, folder))
    return out.select(F.round(F.col("lower") * 10).cast("int").alias("bin"), "count", r("mean_probability").alias("mean_probability"), r("hit_rate").alias("hit_rate"))


@query("m11_probability_quality", _SCORED + f""",
bn AS (SELECT b, count(*) AS c, abs(avg(p) - avg(label)) AS gap FROM (SELECT *, {_BINS} AS b FROM pr) WHERE b IS NOT NULL GROUP BY 1),
q AS (SELECT sum(c) AS sample, count_if(c >= 10) AS k, max(gap) FILTER (WHERE c >= 10) AS g FROM bn),
bb AS (SELECT avg((p - label) ** 2) < avg(label) * (1 - avg(label)) AS beats, count(DISTINCT label) AS cl FROM pr)
SELECT CASE WHEN cl < 2 THEN 'INSUFFICIENT_CLASS_VARIATION' WHEN sample >= 50 AND k >= 2 AND beats AND coalesce(g, 1) <= 0.15 THEN 'CALIBRATED' ELSE 'UNCALIBRATED' END AS status,
  CASE WHEN cl >= 2 AND sample >= 50 AND k >= 2 AND beats AND coalesce(g, 1) <= 0.15 THEN 'PROBABILITY' ELSE 'SHADOW_SCORE' END AS display, sample, round(g, 6) AS max_calibration_gap, beats AS beats_base_rate_brier FROM q, bb""")
def m11(spark: SparkSession, folder: str) -> DataFrame:
    out = learning.probability_quality(scored_rows(spark, folder))
    return out.withColumn("max_calibration_gap", r("max_calibration_gap"))


@query("m12_retrain_decision", TRAIN + """
SELECT t AS trained_on, CASE WHEN c < 200 THEN 'BELOW_THRESHOLD' WHEN t = c THEN 'SCORE_MISSING' ELSE 'TRAIN' END AS decision FROM (SELECT count(*) AS c FROM tr), (SELECT unnest([0, 100, (SELECT count(*)::INT FROM tr)]) AS t)""")
def m12(spark: SparkSession, folder: str) -> DataFrame:
    eligible = training_rows(spark, folder).count()
    rows = [(t, learning.retrain_decision(eligible, t)) for t in (0, 100, eligible)]
    return spark.createDataFrame(rows, "trained_on int, decision string")
