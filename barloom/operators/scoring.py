"""Trend, regime and score rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import decimals, six_digits, two_decimals

# The strategy names, cut-offs and points below must give the published scores.
INTRADAY_STRATEGY = "radar-intraday-v1"
DAILY_STRATEGY = "radar-v1-frozen"
TREND_FLAGS = (
    "price_above_ema20", "price_above_ema50", "price_above_ema200", "ema20_above_ema50",
    "ema50_above_ema200", "higher_high", "higher_low",
)
TREND_POINTS = {
    "STRONG_UPTREND": 15, "UPTREND": 11, "NEUTRAL": 6, "DOWNTREND": 2, "STRONG_DOWNTREND": 0,
}
REGIME_POINTS = {"RISK_ON": 10, "NEUTRAL": 6, "RISK_OFF": 1}
COMPONENTS = (
    "trend", "momentum", "relative_volume", "breakout", "relative_strength", "volatility",
    "market_regime", "risk_reward",
)


def _points(table: dict[str, int], key: Column) -> Column:
    expression = F.lit(None).cast("int")
    for name, points in table.items():
        expression = F.when(key == name, points).otherwise(expression)
    return expression


def _steps(value: Column, cuts: list[tuple[float, int]], below: int) -> Column:
    """Points of the first cut the value reaches; a missing value reaches none."""
    expression = F.lit(below)
    for cut, points in reversed(cuts):
        expression = F.when(value >= cut, points).otherwise(expression)
    return expression


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def trend() -> Column:
    positives = sum((F.col(flag).cast("int") for flag in TREND_FLAGS), F.lit(0))
    slope = F.col("ema20_slope")
    return (
        F.when((positives >= 6) & F.coalesce(slope > 0, F.lit(False)), "STRONG_UPTREND")
        .when(positives >= 4, "UPTREND")
        .when((positives <= 1) & F.coalesce(slope < 0, F.lit(False)), "STRONG_DOWNTREND")
        .when(positives <= 2, "DOWNTREND")
        .otherwise("NEUTRAL")
    )


def regime(trend_name: str = "trend", rsi: str = "rsi") -> Column:
    name, level = F.col(trend_name), F.col(rsi)
    return (
        F.when(name.isin("STRONG_UPTREND", "UPTREND") & (level >= 50), "RISK_ON")
        .when(name.isin("STRONG_DOWNTREND", "DOWNTREND") & (level < 45), "RISK_OFF")
        .otherwise("NEUTRAL")
    )


def signal_class(score: Column) -> Column:
    return (
        F.when(score >= 90, "VERY_STRONG_CANDIDATE").when(score >= 80, "STRONG_CANDIDATE")
        .when(score >= 70, "CANDIDATE").when(score >= 60, "WATCH").otherwise("NO_SIGNAL")
    )


def score_daily(
    frame: DataFrame,
    risk_reward: str = "risk_reward",
    status: str = "data_status",
    quality: str = "data_quality",
    min_quality: float = 90,
) -> DataFrame:
    """Adds ``components`` (struct), ``score``, ``signal_class`` and ``reasons``.

    The gate fails closed: any doubt about data or risk gives zero points everywhere.
    Reads the daily features, ``trend_name``, ``regime`` and ``relative_strength``.
    """
    rvol, hist = F.col("rvol"), F.col("macd_histogram")
    passed = (
        (F.col(status) == "OK") & (F.col(quality) >= min_quality) & (F.col(risk_reward) >= 2)
    )
    momentum = F.bround(
        (F.col("rsi") - 40) / 3
        + F.when(hist > 0, 5).otherwise(0)
        + F.when(F.col("roc") > 0, 3).otherwise(0)
    ).cast("int")
    confirmed = F.col("breakout") & (rvol >= 1.5) & (F.col("close_quality") >= 0.65)
    points = {
        "trend": _points(TREND_POINTS, F.col("trend_name")),
        "momentum": _clamp(momentum, 0, 15),
        "relative_volume": _steps(rvol, [(3, 20), (2, 18), (1.5, 15), (1, 10)], 4),
        "breakout": F.when(confirmed, 15).when(F.col("breakout"), 5).otherwise(2),
        "relative_strength": _clamp(F.bround(5 + F.col("relative_strength")).cast("int"), 0, 10),
        "volatility": F.when(F.col("volatility") < 0.04, 4).otherwise(2),
        "market_regime": _points(REGIME_POINTS, F.col("regime")),
        "risk_reward": F.least(F.lit(10), F.bround(F.col(risk_reward) * 3.5).cast("int")),
    }
    gated = {name: F.when(passed, value).otherwise(0).cast("int") for name, value in points.items()}
    out = frame.withColumn("components", F.struct(*[v.alias(k) for k, v in gated.items()]))
    total = sum((F.col(f"components.{c}") for c in COMPONENTS), F.lit(0))
    out = out.withColumn("score", F.least(F.lit(100), total).cast("int"))
    reasons = F.array(
        F.concat(F.lit("Trend: "), F.col("trend_name")),
        F.concat(F.lit("Relative volume: "), two_decimals(rvol), F.lit("x")),
        F.when(hist > 0, "Positive MACD momentum").otherwise("Negative MACD momentum"),
        F.when(F.col("components.breakout") == 15, "Resistance breakout confirmed").otherwise("No confirmed breakout"),
        F.concat(F.lit("Market regime: "), F.col("regime")),
    )
    failed = F.array(F.lit("Fail-closed: data or risk gate failed"))
    return out.withColumns({
        "signal_class": signal_class(F.col("score")),
        "reasons": F.when(passed, reasons).otherwise(failed),
    })


def intraday_score() -> Column:
    momentum = _clamp(F.floor((F.col("rsi") - 35) / 2).cast("int"), 0, 25)
    above = sum(
        (F.when(F.col(f"ema{p}_distance") >= 0, 7).otherwise(0) for p in (9, 20, 50)), F.lit(0)
    )
    volume = _steps(F.col("rvol"), [(2, 25), (1.5, 18)], 10)
    breakout = _steps(F.col("breakout_distance"), [(0, 18), (-1, 10)], 2)
    macd = F.when(F.col("macd_histogram") > 0, 11).otherwise(0)
    return _clamp(F.coalesce(momentum, F.lit(0)) + above + volume + breakout + macd, 0, 100).cast("int")


def early_momentum_score() -> Column:
    # A rise from zero volume is an unbounded acceleration.
    jump = (F.col("volume_acceleration") > 0.25) | ((F.col("previous_volume") == 0) & (F.col("volume") > 0))
    rules = [
        _steps(F.col("rvol"), [(1.5, 18), (1.0, 9)], 0),
        F.when(jump, 15).otherwise(5),
        F.when(F.col("price_acceleration") > 0, 14).otherwise(0),
        F.when(F.col("vwap_distance") >= 0, 12).otherwise(0),
        F.when(F.col("ema9_distance") >= 0, 12).otherwise(0),
        F.when(F.col("ema20_distance") >= 0, 10).otherwise(0),
        F.when(F.col("breakout_distance") >= -0.5, 12).otherwise(0),
        F.when(F.col("macd_histogram") > 0, 7).otherwise(0),
    ]
    return _clamp(sum(rules, F.lit(0)), 0, 100).cast("int")


SNAPSHOT_FEATURES = (
    "rsi", "macd", "macd_histogram", "rvol", "atr", "vwap_distance", "ema9_distance", "ema20_distance",
    "ema50_distance", "breakout_distance", "volume_acceleration", "price_acceleration",
)


def snapshots(features: DataFrame, received_at: Column, timeframe: str = "15m", quality: Column | None = None) -> DataFrame:
    """One signal snapshot per feature row: id, scores, class, latency and the feature columns."""
    quality = F.lit(100.0) if quality is None else quality
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+00:00")
    out = features.withColumn("data_quality", quality)
    out = out.withColumn(
        "radar_score", F.when(F.col("data_quality") >= 90, intraday_score()).otherwise(0)
    )
    return out.select(
        F.concat_ws(":", F.lit(INTRADAY_STRATEGY), "symbol", stamp).alias("signal_id"),
        "symbol", "ts", F.lit(timeframe).alias("timeframe"), F.col("close").alias("price"),
        "radar_score", signal_class(F.col("radar_score")).alias("classification"),
        early_momentum_score().alias("early_momentum_score"),
        *SNAPSHOT_FEATURES, "rvol_method", "low10", "bar_no", "data_quality",
        F.lit(None).cast("double").alias("relative_strength"),
        F.lit("UNKNOWN").alias("market_regime"), F.lit("UNKNOWN").alias("daily_trend"),
        (F.unix_micros(received_at) / 1e6 - F.unix_micros("ts") / 1e6).alias("provider_latency_seconds"),
    )


# Ordered phrases and their categories; the first phrase found wins.
PHRASES = {
    "temettü": "dividend",
    "geri alım": "buyback",
    "ihale": "tender",
    "kapasite": "capacity_increase",
    "sermaye artır": "capital_increase",
    "finansal sonuç": "financial_results",
    "dava": "lawsuit",
    "borçlan": "borrowing",
    "faaliyet durdur": "operations_halted",
    "ortak satış": "shareholder_sale",
    "yatırım": "investment",
    "iş ilişkisi": "new_business",
}


def classify_text(text: Column, phrases: dict[str, str] | None = None) -> Column:
    """Category of the first phrase contained in the lower-cased text (Java lower, not case folding)."""
    lowered = F.lower(text)
    expression = F.lit("other")
    for phrase, category in reversed(list((phrases or PHRASES).items())):
        expression = F.when(F.contains(lowered, F.lit(phrase)), category).otherwise(expression)
    return expression


def score_bucket(score: Column) -> Column:
    return F.when(score >= 90, "90+").when(score >= 80, "80-89").otherwise("70-79")


def rvol_bucket(rvol: Column) -> Column:
    return (
        F.when(rvol < 1, "<1").when(rvol < 2, "1-2").when(rvol < 3, "2-3").when(rvol < 5, "3-5").otherwise("5+")
    )


def rvol_accuracy_bucket(rvol: Column) -> Column:
    return F.when(rvol >= 2, "2+").when(rvol >= 1.5, "1.5-2").otherwise("<1.5")


def momentum_bucket(score: Column) -> Column:
    return F.when(score < 60, "<60").when(score < 80, "60-79").when(score < 90, "80-89").otherwise("90+")


def sample_maturity(n: Column) -> Column:
    return (
        F.when(n < 50, "INSUFFICIENT_DATA").when(n < 200, "EXPERIMENTAL").when(n < 500, "EARLY")
        .when(n < 2000, "MODERATE_SAMPLE").otherwise("MATURE_SAMPLE")
    )


def alert_reason(now: Column, max_age_minutes: int, market_open: Column) -> Column:
    """Null when an alert may go out, else the first reason against it."""
    age = F.unix_micros(now) - F.unix_micros("ts")
    stale = (age > max_age_minutes * 60_000_000) | (age < 0)
    strong = F.col("classification").isin("STRONG_CANDIDATE", "VERY_STRONG_CANDIDATE")
    return (
        F.when(~market_open, "ALERT_SUPPRESSED_MARKET_CLOSED")
        .when(stale, "ALERT_SUPPRESSED_STALE_DATA")
        .when(~strong, "ALERT_SUPPRESSED_CLASS")
    )


# Lines of the alert and research messages.
ALERT_TITLES = ("🔥 BIST RADAR — ÇOK GÜÇLÜ ADAY", "🔥 BIST RADAR — GÜÇLÜ ADAY")
RESEARCH_TITLE = "🔥 BIST RADAR — RESEARCH"
PAPER_ONLY = "RESEARCH / PAPER ONLY"
DISCLAIMER = "Bu sistem yatırım tavsiyesi değildir."
ALERT_DISCLAIMER = "Bu sistem yatırım tavsiyesi değildir.\nKarar-destek ve paper trading amaçlıdır."
NO_RATIO = "Veri yok"


def _utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def _lines(*parts: Column | str) -> Column:
    return F.array_join(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "\n")


def alert_text(now: Column, shadow_status: str | Column) -> Column:
    """Message of a candidate: symbol, radar_score, price, rvol, early_momentum_score, risk_reward and ts."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("ts")) / 60e6)
    ratio = F.when(F.col("risk_reward").isNull(), NO_RATIO).otherwise(F.concat(F.lit("1:"), decimals(F.col("risk_reward"), 1)))
    return _lines(
        F.when(F.col("radar_score") >= 90, ALERT_TITLES[0]).otherwise(ALERT_TITLES[1]), "", F.col("symbol"),
        F.format_string("Radar: %d/100", "radar_score"), F.concat(F.lit("Fiyat: "), six_digits(F.col("price"))),
        F.concat(F.lit("15m RVOL: "), two_decimals(F.col("rvol")), F.lit("x")), F.format_string("Early Momentum: %d", "early_momentum_score"),
        F.concat(F.lit("Risk/Getiri: "), ratio), "", F.concat(F.lit("Veri zamanı: "), _utc_text(F.col("ts"))),
        F.concat(F.lit("Veri yaşı: "), decimals(age, 0), F.lit(" dk")), "", "Shadow:", shadow_status, "", PAPER_ONLY, ALERT_DISCLAIMER,
    )


def research_text(shadow: Column | None = None) -> Column:
    """Message of a snapshot; ``shadow`` is a map from head to probability, its part left out where it is null or empty."""
    head = _lines(
        RESEARCH_TITLE, "", F.col("symbol"), F.format_string("Radar: %d", "radar_score"),
        F.concat(F.lit("15m RVOL: "), two_decimals(F.col("rvol")), F.lit("x")), F.format_string("Early momentum: %d", "early_momentum_score"),
        F.concat(F.lit("Data timestamp: "), _utc_text(F.col("ts"))),
        F.concat(F.lit("Data latency: "), decimals(F.col("provider_latency_seconds") / 60, 1), F.lit("m")),
    )
    tail = _lines("", PAPER_ONLY, DISCLAIMER)
    if shadow is None:
        return F.concat_ws("\n", head, tail)
    items = F.transform(F.map_entries(shadow), lambda e: F.concat(e["key"], F.lit(": "), decimals(e["value"] * 100, 1), F.lit("%")))
    middle = F.when(F.size(F.coalesce(F.map_keys(shadow), F.array().cast("array<string>"))) > 0, F.concat(F.lit("\nShadow ML:\n"), F.array_join(items, "\n"), F.lit("\nMode: SHADOW")))
    return F.concat_ws("\n", head, middle, tail)
