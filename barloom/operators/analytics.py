"""Signal records and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.scoring import momentum_bucket, rvol_accuracy_bucket, rvol_bucket, score_bucket
from barloom.quantiles import exact_quantiles
from barloom.schema import EXCHANGE_ZONE

# Audit results that end a setup, and the training threshold.
TERMINAL_RESULTS = ("NO_ENTRY", "STOPPED", "H3_REACHED", "EXPIRED_H0", "EXPIRED_H1", "EXPIRED_H2")
TRAINING_THRESHOLD = 200
HITS = ("entry_hit_at", "stop_hit_at", "target1_hit_at", "target2_hit_at", "target3_hit_at", "terminal_at")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, half to even; null when the end is missing."""
    return F.bround((F.unix_micros(end) - F.unix_micros(start)) / 60e6).cast("long")


def newest_prediction(predictions: DataFrame) -> DataFrame:
    others = [c for c in predictions.columns if c != "signal_id"]
    newest = predictions.groupBy("signal_id").agg(F.max_by(F.struct(*others), F.col("created_at")).alias("_p"))
    return newest.select("signal_id", *[F.col(f"_p.{c}").alias(c) for c in others])


def signal_records(signals: DataFrame, outcomes: DataFrame, audits: DataFrame, lifecycle: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Signals with all outcomes (a map by horizon), their audit with minutes to each event, their
    labelling state and newest prediction."""
    values = [c for c in outcomes.columns if c not in ("signal_id", "horizon")]
    by_horizon = outcomes.groupBy("signal_id").agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", F.struct(*values)))).alias("outcomes")  # six horizons
    )
    rows = signals.join(lifecycle, "signal_id", "left").join(by_horizon, "signal_id", "left").join(audits, "signal_id", "left")
    rows = rows.withColumns({
        "ordering": F.coalesce("ordering", F.lit("NONE")),
        "result_classification": F.coalesce("result_classification", F.lit("PENDING")),
        "score_bucket": score_bucket(F.col("radar_score")),
        **{name.replace("_at", "_minutes"): minutes_between(F.col("ts"), F.col(name)) for name in HITS},
    })
    if predictions is None:
        return rows
    return rows.join(newest_prediction(predictions), "signal_id", "left")


def _group_key(group: str) -> Column:
    if group == "score":
        return F.col("score_bucket")
    if group == "rvol":
        return rvol_bucket(F.coalesce("rvol", F.lit(0.0)))
    return momentum_bucket(F.coalesce("early_momentum_score", F.lit(0)))


def bucket_analytics(records: DataFrame, group: str = "score", horizon: str = "120m") -> DataFrame:
    """Hit rates and excursions per bucket over signals whose label is mature."""
    label = F.col("outcomes")[horizon]
    rows = records.withColumns({
        "bucket": _group_key(group), "_mature": F.coalesce(label["status"] == "LABEL_AVAILABLE", F.lit(False)),
    }).withColumns({
        "_mfe": F.when(F.col("_mature"), label["maximum_favorable_excursion"]),
        "_mae": F.when(F.col("_mature"), label["maximum_adverse_excursion"]),
    })

    def rate(test: Column) -> Column:
        return F.avg(F.when(F.col("_mature"), test.cast("int")))

    base = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("unique_signals"), F.count_if("_mature").alias("mature_signals"),
        *[rate(F.col(f"target{k}_hit_at").isNotNull()).alias(f"h{k}_hit_rate") for k in (1, 2, 3)],
        rate(F.col("ordering") == "STOP_FIRST").alias("stop_first_rate"),
        F.avg("_mfe").alias("average_mfe"), F.avg("_mae").alias("average_mae"),
    )
    for value in ("mfe", "mae"):
        middle = exact_quantiles(rows, ["bucket"], f"_{value}", {f"median_{value}": (0.5, "linear")})
        base = base.join(middle, "bucket", "left")
    return base


def daily_summary(records: DataFrame, days: int = 7) -> DataFrame:
    """Counts per exchange-local date, newest dates first."""
    local = F.to_date(F.from_utc_timestamp("ts", EXCHANGE_ZONE))

    def count(test: Column, name: str) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False))).alias(name)

    klass, state, result = F.col("classification"), F.col("lifecycle"), F.col("result_classification")
    return records.groupBy(local.alias("date")).agg(
        F.count(F.lit(1)).alias("total"),
        count(klass == "VERY_STRONG_CANDIDATE", "very_strong"), count(klass == "STRONG_CANDIDATE", "strong"), count(klass == "CANDIDATE", "candidate"),
        count(state == "FULLY_LABELED", "completed"), count(state == "OUTCOME_PENDING", "pending"), count(state == "PARTIALLY_LABELED", "partial"),
        *[count(F.col(f"target{k}_hit_at").isNotNull(), f"h{k}_hits") for k in (1, 2, 3)],
        count(F.col("entry_hit_at").isNotNull(), "entered"), count(result == "NO_ENTRY", "no_entry"), count(result == "STOPPED", "stopped"),
    ).orderBy(F.desc("date")).limit(days)


def accuracy_buckets(rows: DataFrame, group: str = "score") -> DataFrame:
    """Label accuracy per bucket; ``group`` is score, rvol or any column."""
    if group == "score":
        key = score_bucket(F.col("radar_score"))
    elif group == "rvol":
        key = rvol_accuracy_bucket(F.col("rvol"))
    else:
        key = F.coalesce(F.col(group).cast("string"), F.lit("UNKNOWN"))
    labelled = F.col("hit_plus_1_percent").isNotNull()
    return rows.groupBy(key.alias("bucket")).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(labelled).alias("labeled"),
        F.avg(F.col("hit_plus_1_percent").cast("int")).alias("plus_1_hit_rate"),
        F.avg(F.when(labelled, F.col("maximum_favorable_excursion"))).alias("average_mfe"),
        F.avg(F.when(labelled, F.col("maximum_adverse_excursion"))).alias("average_mae"),
    )


def outcome_summary(outcomes: DataFrame, horizons: tuple[str, ...] = ("15m", "30m", "60m", "120m", "EOD", "NEXT_DAY")) -> DataFrame:
    """One row per signal: a forward return per horizon, the highest MFE and the lowest MAE."""
    ready = F.col("status") == "LABEL_AVAILABLE"
    return outcomes.groupBy("signal_id").agg(
        *[F.max(F.when(ready & (F.col("horizon") == h), F.col("forward_return"))).alias(f"forward_return_{h.lower()}") for h in horizons],
        F.max(F.when(ready, F.col("maximum_favorable_excursion"))).alias("maximum_favorable_excursion"),
        F.min(F.when(ready, F.col("maximum_adverse_excursion"))).alias("maximum_adverse_excursion"),
    )


def shadow_status(signals: DataFrame, lifecycle: DataFrame, audits: DataFrame, models: int = 0) -> DataFrame:
    """Observation counts and training progress (one row)."""
    seen = signals.select("signal_id").join(lifecycle, "signal_id", "left").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("lifecycle") == "FULLY_LABELED").alias("labeled"))
    ready = audits.filter((F.col("audit_version") == 2) & F.col("result_classification").isin(*TERMINAL_RESULTS)).agg(
        F.count(F.lit(1)).alias("training_eligible"))
    out = seen.crossJoin(F.broadcast(ready))  # one row each
    eligible = F.col("training_eligible")
    return out.withColumns({
        "excluded": F.col("observations") - eligible,
        "progress_percent": F.least(F.lit(100.0), F.bround(eligible / TRAINING_THRESHOLD * 100, 1)),
        "remaining": F.greatest(F.lit(0), F.lit(TRAINING_THRESHOLD) - eligible),
        "status": F.when(F.lit(models > 0), "MODEL_READY").when(eligible >= TRAINING_THRESHOLD, "EĞİTİM_BEKLİYOR").otherwise("VERİ_TOPLANIYOR"),
    })


def class_counts(candidates: DataFrame, classes: tuple[str, ...] = ("VERY_STRONG_CANDIDATE", "STRONG_CANDIDATE", "CANDIDATE", "WATCH")) -> DataFrame:
    """Candidates per class, zero where a class has none."""
    one = candidates.agg(F.array(*[
        F.struct(F.lit(c).alias("classification"), F.count_if(F.col("classification") == c).alias("candidates")) for c in classes
    ]).alias("_c"))
    return one.select(F.explode("_c").alias("_c")).select("_c.classification", "_c.candidates")
