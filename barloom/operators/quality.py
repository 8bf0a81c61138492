"""Quality gates: row checks, series validation, completeness, freshness and liquidity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import (
    DELAYED_ALLOWANCE_SECONDS, EXCHANGE_ZONE, STALE_SECONDS, TIMEFRAME_SECONDS, VALUES,
)

# Instrument code pattern and the order and wording of the series checks.
SYMBOL_PATTERN = "^[A-Z0-9]{2,12}$"
CHECKS = (
    "invalid timestamp", "duplicate bar", "bars out of order", "non-numeric value",
    "non-positive price", "negative volume", "invalid OHLC", "invalid symbol", "unexpected symbol",
    "abnormal jump; corporate action adjustment required",
)
MISSING = "missing rows or columns"
SESSION_OPEN, SESSION_END = "10:00:00", "18:10:00"


def ohlc_broken() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (l > o) | (o > h) | (l > c) | (c > h)


def row_errors() -> Column:
    """All row-level errors of a canonical bar."""
    low = F.least("open", "high", "low", "close")
    rules = [
        (low <= 0, "non-positive price"),
        (F.col("volume") < 0, "negative volume"),
        (ohlc_broken(), "invalid OHLC"),
        (F.col("received_at") < F.col("ts"), "received before bar time"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with ``errors``)."""
    checked = bars.withColumn("errors", row_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def arrival_pairs(bars: DataFrame, slice_rows: int = 65536) -> DataFrame:
    """``prev_ts`` and ``prev_close`` of the row that arrived just before, per symbol.

    Arrival order is cut into ranges of ``ingest_seq``; only the first row of a range needs its
    predecessor from an earlier one, and that comes from one small row per range.
    """
    base = bars.withColumn("_range", F.floor(F.col("ingest_seq") / F.lit(slice_rows)))
    inside = Window.partitionBy("symbol", "_range").orderBy("ingest_seq")
    tail = base.groupBy("symbol", "_range").agg(
        F.max_by(F.struct("ts", "close"), F.col("ingest_seq")).alias("_tail")
    )
    over = Window.partitionBy("symbol").orderBy("_range")
    before = tail.select("symbol", "_range", F.lag("_tail").over(over).alias("_before"))
    out = base.withColumns({
        "_at": F.row_number().over(inside),
        "_ts": F.lag("ts").over(inside),
        "_close": F.lag("close").over(inside),
    }).join(before, ["symbol", "_range"])
    first = F.col("_at") == 1
    return out.withColumns({
        "prev_ts": F.when(first, F.col("_before.ts")).otherwise(F.col("_ts")),
        "prev_close": F.when(first, F.col("_before.close")).otherwise(F.col("_close")),
    }).drop("_range", "_at", "_ts", "_close", "_before")


def validate_series(
    bars: DataFrame, now: Column, stale_seconds: int = 172800, max_jump_percent: float = 40.0,
    group: str = "symbol", slice_rows: int = 65536, expected: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol: status, quality score and the list of failed checks.

    Symbols of ``expected`` without any bar are MISSING with a score of 0.
    """
    paired = arrival_pairs(bars, slice_rows)
    copies = bars.filter(F.col("ts").isNotNull()).groupBy(group, "ts").agg(F.count(F.lit(1)).alias("_n"))
    doubled = copies.groupBy(group).agg((F.max("_n") > 1).alias("_doubled"))
    jump = F.abs(F.col("close") / F.nullif("prev_close", F.lit(0.0)) - 1) * 100 > max_jump_percent
    numeric_missing = F.lit(False)
    for name in VALUES:
        numeric_missing = numeric_missing | F.col(name).isNull()

    def any_(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    flags = paired.groupBy(group).agg(
        any_(F.col("ts").isNull()).alias("f0"),
        any_(F.col("ts") < F.col("prev_ts")).alias("f2"),
        any_(numeric_missing).alias("f3"),
        any_(F.least("open", "high", "low", "close") <= 0).alias("f4"),
        any_(F.col("volume") < 0).alias("f5"),
        any_(ohlc_broken()).alias("f6"),
        any_(~F.col("symbol").rlike(SYMBOL_PATTERN)).alias("f7"),
        (F.min("symbol") != F.max("symbol")).alias("f8"),
        any_(jump).alias("f9"),
        F.max("ts").alias("_newest"),
    ).join(doubled, group, "left").withColumn("f1", F.coalesce("_doubled", F.lit(False)))
    errors = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(text)) for i, text in enumerate(CHECKS)]))
    out = flags.withColumn("errors", errors)
    stale = (F.unix_micros(now) - F.unix_micros("_newest")) > stale_seconds * 1_000_000
    invalid = F.size("errors") > 0
    found = out.select(
        group,
        F.when(invalid, "INVALID").when(stale, "STALE").otherwise("OK").alias("status"),
        F.when(invalid, F.greatest(F.lit(0.0), 100.0 - F.size("errors") * 20.0))
        .when(stale, 70.0).otherwise(100.0).alias("quality_score"),
        F.when(~invalid & stale, F.array(F.lit("stale data"))).otherwise(F.col("errors")).alias("errors"),
    )
    if expected is None:
        return found
    absent = expected.select(group).distinct().join(found.select(group), group, "left_anti").select(
        group, F.lit("MISSING").alias("status"), F.lit(0.0).alias("quality_score"), F.array(F.lit(MISSING)).alias("errors"))
    return found.unionByName(absent)


# Reasons for which a history is refused, in the order of the checks.
NO_HISTORY = "malformed historical data"
REFUSALS = (
    ("bad_timestamp", "invalid timestamp"), ("unordered", "unordered historical data"),
    ("duplicate", "duplicate historical bar"), ("foreign", "unexpected symbol"),
)


def refused_histories(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """symbol and the first reason for which its history is refused; symbols without a fault are left out.

    ``expected`` lists the symbols asked for: one without bars is refused, and so are bars of
    any other symbol.
    """
    asked = expected.select("symbol").distinct().withColumn("_asked", F.lit(True))
    both = history_problems(bars).withColumn("_has", F.lit(True)).join(asked, "symbol", "full_outer")
    both = both.withColumn("foreign", F.col("_asked").isNull())
    reason = F.when(F.col("_has").isNull(), NO_HISTORY)
    for flag, text in REFUSALS:
        reason = reason.when(F.coalesce(F.col(flag), F.lit(False)), text)
    return both.select("symbol", reason.alias("reason")).filter(F.col("reason").isNotNull())


def history_problems(bars: DataFrame) -> DataFrame:
    """One row per symbol: whether its timestamps are broken, out of order or doubled."""
    paired = arrival_pairs(bars)
    return paired.groupBy("symbol").agg(
        F.coalesce(F.bool_or(F.col("ts").isNull()), F.lit(False)).alias("bad_timestamp"),
        F.coalesce(F.bool_or(F.col("ts") < F.col("prev_ts")), F.lit(False)).alias("unordered"),
        F.coalesce(F.bool_or(F.col("ts") == F.col("prev_ts")), F.lit(False)).alias("duplicate"),
    )


# --- completeness and freshness --------------------------------------------------------------

def completed_intraday(ts: Column, minutes: int, now: Column, delay_minutes: int = 0) -> Column:
    return F.unix_micros(ts) + (minutes + delay_minutes) * 60_000_000 <= F.unix_micros(now)


def completed_daily(ts: Column, now: Column) -> Column:
    """Local clock has reached 18:40 on the bar's local date (close 18:10 plus 30 minutes)."""
    local_bar = F.date_trunc("DAY", F.from_utc_timestamp(ts, EXCHANGE_ZONE))
    return F.from_utc_timestamp(now, EXCHANGE_ZONE) >= local_bar + F.expr("INTERVAL '18:40' HOUR TO MINUTE")


def in_session(ts: Column) -> Column:
    """Weekday and local time between 10:00 and 18:10, both ends included."""
    local = F.from_utc_timestamp(ts, EXCHANGE_ZONE)
    clock = F.date_format(local, "HH:mm:ss.SSSSSS")
    return (F.weekday(local) < 5) & (clock >= f"{SESSION_OPEN}.000000") & (clock <= f"{SESSION_END}.000000")


def freshness_state(ts: Column, now: Column, stale_minutes: int = 45) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ts)) / 60e6)
    return (
        F.when(ts.isNull(), "UNKNOWN").when(~in_session(now), "MARKET_CLOSED")
        .when(age <= stale_minutes, "FRESH").when(age <= stale_minutes * 3, "DELAYED").otherwise("STALE")
    )


def is_stale(timeframe: Column, ts: Column, now: Column, delayed: bool = False) -> Column:
    limit = F.lit(None).cast("long")
    for name, seconds in STALE_SECONDS.items():
        limit = F.when(timeframe == name, F.lit(seconds)).otherwise(limit)
    allowance = DELAYED_ALLOWANCE_SECONDS if delayed else 0
    return F.unix_micros(now) - F.unix_micros(ts) > (limit + allowance) * 1_000_000


def sequence_state(numbered: DataFrame, timeframe: str, calendar_verified: bool, size: int = 1024) -> DataFrame:
    """OK or MISSING per symbol from gaps between consecutive bars; UNKNOWN without a calendar."""
    from barloom.series import blocked

    if not calendar_verified:
        return numbered.groupBy("symbol").agg(F.lit("UNKNOWN").alias("sequence"))
    s = blocked(numbered, halo=1, size=size)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(s.w)) > TIMEFRAME_SECONDS[timeframe] * 1_000_000
    rows = s.add({"_gap": gap}).rows()
    return rows.groupBy("symbol").agg(
        F.when(F.coalesce(F.bool_or("_gap"), F.lit(False)), "MISSING").otherwise("OK").alias("sequence")
    )


# --- liquidity -------------------------------------------------------------------------------

def liquidity_rejection(
    bars: DataFrame, min_value: float = 0, min_volume: float = 0, min_bars: int = 0, min_price: float = 0
) -> DataFrame:
    stats = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("volume").alias("_volume"),
        F.avg(F.col("close") * F.col("volume")).alias("_value"), F.max_by("close", "ts").alias("_last"),
    )
    low = (F.col("_n") < min_bars) | (F.col("_volume") < min_volume) | (F.col("_value") < min_value)
    return stats.select(
        "symbol",
        F.when(low, "REJECTED_LOW_LIQUIDITY").when(F.col("_last") < min_price, "REJECTED_PRICE_FLOOR").alias("rejection"),
    )


def latest_rows(bars: DataFrame, n: int, name: str = "rank") -> DataFrame:
    """The n newest rows per symbol; Spark trims each partition to n before the shuffle."""
    over = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn(name, F.row_number().over(over)).filter(F.col(name) <= n)


def stage_a_screen(bars: DataFrame, minimum_history: int = 50) -> DataFrame:
    """Cheap activity screen on the last 20 bars; a volume and price spike overrides thin trading."""
    history = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    recent = latest_rows(bars, 20)
    stats = recent.groupBy("symbol").agg(
        F.avg((F.col("volume") > 0).cast("int")).alias("_active"),
        F.median(F.when((F.col("rank") > 1) & (F.col("volume") > 0), F.col("volume"))).alias("_usual"),
        F.max(F.when(F.col("rank") == 1, F.col("volume"))).alias("_volume"),
        F.max(F.when(F.col("rank") == 1, F.col("close"))).alias("_close"),
        F.max(F.when(F.col("rank") == 2, F.col("close"))).alias("_before"),
    )
    spike = (F.col("_usual") > 0) & (F.col("_volume") >= F.col("_usual") * 3)
    moved = F.abs(F.col("_close") / F.nullif("_before", F.lit(0.0)) - 1) >= 0.02
    return history.join(stats, "symbol").select(
        "symbol",
        F.when(F.col("bars") < minimum_history, "LIMITED_HISTORY")
        .when(F.col("_active") >= 0.8, "ELIGIBLE")
        .when(F.coalesce(spike & moved, F.lit(False)), "EARLY_MOVER_OVERRIDE")
        .otherwise("LIQUIDITY_FILTER").alias("reason"),
    )


# --- cross-source ----------------------------------------------------------------------------

def compare_sources(a: DataFrame, b: DataFrame, price_tolerance: float = 0.001, volume_tolerance: float = 0.01) -> DataFrame:
    """Bars present in both sources and whether they agree."""
    left, right = a.alias("a"), b.alias("b")
    joined = left.join(right, ["symbol", "ts", "timeframe"])

    def near(name: str, tolerance: float) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= tolerance

    agree = near("volume", volume_tolerance)
    for name in ("open", "high", "low", "close"):
        agree = agree & near(name, price_tolerance)
    return joined.select("symbol", "ts", "timeframe", agree.alias("agree"))


def corporate_action(open_: Column, previous_close: Column, threshold_percent: float = 25.0) -> Column:
    return F.coalesce(
        F.abs(open_ / F.nullif(previous_close, F.lit(0.0)) - 1) * 100 > threshold_percent, F.lit(False)
    )
