"""Forward labels: what happened to each signal in the bars after it.

Signals meet later bars through bar numbers: a signal at bar n needs bars n+1..n+N, an equi-join on
(symbol, bar number) after exploding the short range.  No inequality join is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import EXCHANGE_ZONE

# Horizons in completed bars, and the windows of the level audit.
HORIZONS = {"15m": 1, "30m": 2, "60m": 4, "120m": 8}
ENTRY_BARS = 8
MANAGED_BARS = 16
HIT_PERCENTS = (1, 2, 3, 5)
SESSION_CLOSE_HOUR = 18


def completed(bars: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return bars.filter(F.unix_micros("ts") <= F.unix_micros(now) - minutes * 60_000_000)


def attach_next(signals: DataFrame, bars: DataFrame, n: int, id_columns: tuple[str, ...]) -> DataFrame:
    """Rows (signal columns, i, bar columns) for the next ``n`` bars that exist, i from 1.

    Both sides carry symbol and bar_no; the signal's bar_no is that of its own bar.
    """
    wanted = signals.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "_bar", F.col("bar_no") + F.col("i")
    ).drop("bar_no")
    side = bars.select(
        "symbol", F.col("bar_no").alias("_bar"), F.col("ts").alias("bar_ts"),
        *[F.col(c).alias(c) for c in ("open", "high", "low", "close", "volume") if c in bars.columns],
        *[c for c in bars.columns if c.startswith("ctx_")],
    )
    return wanted.join(side, ["symbol", "_bar"]).drop("_bar")


def _outcome(price: Column, stop: Column, keep: Column, order: Column) -> list[Column]:
    """Excursion aggregates over the rows where ``keep`` holds; ``order`` numbers them in time."""
    high, low = F.when(keep, F.col("high")), F.when(keep, F.col("low"))
    first_stop = F.min(F.when(keep & (F.col("low") <= stop), order))
    first_target = F.min(F.when(keep & (F.col("high") >= price * 1.01), order))
    return [
        (F.max_by("close", F.when(keep, order)) / F.first(price) - 1).alias("forward_return"),
        (F.max(high) / F.first(price) - 1).alias("maximum_favorable_excursion"),
        (F.min(low) / F.first(price) - 1).alias("maximum_adverse_excursion"),
        first_stop.alias("_stop_at"), first_target.alias("_target_at"),
        F.count_if(keep).alias("_n"), F.first(stop).alias("_stop"),
    ]


def _finish(rows: DataFrame, available: Column, unavailable: Column) -> DataFrame:
    """Status, hits and stop-first; everything but the status is null unless available."""
    def only(value: Column) -> Column:
        return F.when(F.col("_ok"), value)

    mfe = F.col("maximum_favorable_excursion")
    stop_first = F.col("_stop_at").isNotNull() & (
        F.col("_target_at").isNull() | (F.col("_stop_at") <= F.col("_target_at"))
    )
    out = rows.withColumn("_ok", F.coalesce(available, F.lit(False)))
    return out.withColumns({
        "status": F.when(F.col("_ok"), "LABEL_AVAILABLE")
        .when(unavailable, "LABEL_UNAVAILABLE").otherwise("LABEL_PENDING"),
        "forward_return": only(F.col("forward_return")),
        **{f"hit_plus_{p}_percent": only(mfe >= p / 100) for p in HIT_PERCENTS},
        "hit_stop_first": only(F.when(F.col("_stop").isNotNull(), stop_first)),
        "maximum_favorable_excursion": only(mfe),
        "maximum_adverse_excursion": only(F.col("maximum_adverse_excursion")),
    }).drop("_ok", "_stop_at", "_target_at", "_n", "_stop")


OUTCOME = (
    "signal_id", "horizon", "status", "forward_return", "maximum_favorable_excursion",
    "maximum_adverse_excursion", *[f"hit_plus_{p}_percent" for p in HIT_PERCENTS], "hit_stop_first",
)


def label_bars(signals: DataFrame, bars: DataFrame, now: Column, dataset_complete: bool = False) -> DataFrame:
    """Outcomes of the bar-count horizons, one row per signal and horizon."""
    done = completed(bars, now)
    near = attach_next(signals.select("signal_id", "symbol", "bar_no", "price", "stop"), done, max(HORIZONS.values()), ("signal_id",))
    horizons = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("bars")) for h, n in HORIZONS.items()])
    wide = near.withColumn("_h", F.explode(F.filter(horizons, lambda h: h["bars"] >= F.col("i")))).select(
        "signal_id", "_h.horizon", "_h.bars", "price", "stop", "i", "high", "low", "close"
    )
    found = wide.groupBy("signal_id", "horizon", "bars").agg(
        *_outcome(F.col("price"), F.col("stop"), F.lit(True), F.col("i"))
    )
    frame = signals.select("signal_id").withColumn("_h", F.explode(horizons)).select(
        "signal_id", "_h.horizon", "_h.bars"
    )
    rows = frame.join(found, ["signal_id", "horizon", "bars"], "left")
    return _finish(rows, F.col("_n") >= F.col("bars"), F.lit(dataset_complete)).select(*OUTCOME)


def label_days(signals: DataFrame, bars: DataFrame, now: Column, dataset_complete: bool = False) -> DataFrame:
    """EOD and NEXT_DAY outcomes on exchange-local dates.

    The later date is the next one present for the symbol; both dates join on (symbol, date), and a
    symbol has at most a day's bars per date.
    """
    done = completed(bars, now).withColumn("day", F.to_date(F.from_utc_timestamp("ts", EXCHANGE_ZONE)))
    dates = done.select("symbol", "day").distinct()
    signal_days = signals.select(
        "signal_id", "symbol", "price", "stop", F.col("ts").alias("signal_time"),
        F.to_date(F.from_utc_timestamp("ts", EXCHANGE_ZONE)).alias("day"),
    )
    # Next present date per (symbol, signal date): one row per date goes through the window.
    every = dates.withColumn("_bar_day", F.col("day")).unionByName(
        signal_days.select("symbol", "day", F.lit(None).cast("date").alias("_bar_day"))
    ).groupBy("symbol", "day").agg(F.max("_bar_day").alias("_bar_day"))
    # latest first, so that the frame only grows and its minimum is kept, not evaluated anew
    later = Window.partitionBy("symbol").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    following = every.select("symbol", "day", F.min("_bar_day").over(later).alias("next_day"))
    plan = signal_days.join(following, ["symbol", "day"])
    choices = F.array(
        F.struct(F.lit("EOD").alias("horizon"), F.col("day").alias("label_day")),
        F.struct(F.lit("NEXT_DAY").alias("horizon"), F.col("next_day").alias("label_day")),
    )
    wanted = plan.withColumn("_h", F.explode(choices)).select(
        "signal_id", "symbol", "price", "stop", "signal_time", "_h.horizon", "_h.label_day"
    )
    joined = wanted.join(done.withColumnRenamed("day", "label_day"), ["symbol", "label_day"], "left")
    keep = F.coalesce(F.col("ts") > F.col("signal_time"), F.lit(False))
    rows = joined.groupBy("signal_id", "horizon", "label_day").agg(
        *_outcome(F.col("price"), F.col("stop"), keep, F.unix_micros("ts"))
    )
    local_now = F.from_utc_timestamp(now, EXCHANGE_ZONE)
    mature = (F.to_date(local_now) > F.col("label_day")) | (
        (F.to_date(local_now) == F.col("label_day")) & (F.hour(local_now) >= SESSION_CLOSE_HOUR)
    )
    return _finish(rows, (F.col("_n") > 0) & mature, F.lit(dataset_complete)).select(*OUTCOME)


def label_all(signals: DataFrame, bars: DataFrame, now: Column, dataset_complete: bool = False) -> DataFrame:
    return label_bars(signals, bars, now, dataset_complete).unionByName(
        label_days(signals, bars, now, dataset_complete)
    )


def lifecycle(outcomes: DataFrame) -> DataFrame:
    """Labelling state per signal."""
    counts = outcomes.groupBy("signal_id").agg(
        F.count_if(F.col("status") == "LABEL_AVAILABLE").alias("_a"),
        F.count_if(F.col("status") == "LABEL_PENDING").alias("_p"),
    )
    return counts.select(
        "signal_id",
        F.when(F.col("_p") == 0, "FULLY_LABELED").when(F.col("_a") > 0, "PARTIALLY_LABELED")
        .otherwise("OUTCOME_PENDING").alias("lifecycle"),
    )


def level_audit(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry within 8 bars, then 16 managed bars from the entry bar; the stop wins inside a bar.

    Reads zone_low, zone_high, stop, t1, t2, t3 (null zone: the plan is unavailable).
    """
    levels = ("zone_low", "zone_high", "stop", "t1", "t2", "t3")
    span = ENTRY_BARS + MANAGED_BARS - 1
    rows = attach_next(signals.select("signal_id", "symbol", "bar_no", *levels), bars, span, ("signal_id",))
    touch = (F.col("i") <= ENTRY_BARS) & (F.col("low") <= F.col("zone_high")) & (F.col("high") >= F.col("zone_low"))
    signal = Window.partitionBy("signal_id")  # at most 23 rows
    rows = rows.withColumn("ei", F.min(F.when(touch, F.col("i"))).over(signal))
    managed = (F.col("i") >= F.col("ei")) & (F.col("i") < F.col("ei") + MANAGED_BARS)

    def first(test: Column) -> Column:
        return F.min(F.when(managed & test, F.struct("i", "bar_ts")))

    high = F.col("high")
    agg = rows.groupBy("signal_id").agg(
        F.max("ei").alias("ei"), F.count_if(F.col("i") <= ENTRY_BARS).alias("_seen"),
        F.max(F.when(F.col("i") == F.col("ei"), F.col("bar_ts"))).alias("_entry_at"),
        F.max(F.when(F.col("i") == F.col("ei"), F.col("open"))).alias("_open"),
        F.max(F.when(F.col("i") <= ENTRY_BARS, F.col("bar_ts"))).alias("_window_end"),
        F.count_if(managed).alias("_managed"), F.max(F.when(managed, F.col("bar_ts"))).alias("_managed_end"),
        first(F.col("low") <= F.col("stop")).alias("_s"), first(high >= F.col("t1")).alias("_h1"),
        first(high >= F.col("t2")).alias("_h2"), first(high >= F.col("t3")).alias("_h3"),
    )
    out = signals.select("signal_id", *levels).join(agg, "signal_id", "left")
    s, h3 = F.col("_s.i"), F.col("_h3.i")
    out = out.withColumns({
        "_planned": F.col("zone_low").isNotNull() & F.col("zone_high").isNotNull(),
        "_stopped": F.coalesce(s.isNotNull() & (h3.isNull() | (s <= h3)), F.lit(False)),
    }).withColumn("_cut", F.when(F.col("_stopped"), s).when(h3.isNotNull(), h3 + 1).otherwise(F.lit(10_000)))

    def hit(k: int) -> Column:
        return F.when(F.col(f"_h{k}.i") < F.col("_cut"), F.col(f"_h{k}.bar_ts"))

    out = out.withColumns({f"target{k}_hit_at": hit(k) for k in (1, 2, 3)})
    highest = (
        F.when(F.col("target3_hit_at").isNotNull(), 3).when(F.col("target2_hit_at").isNotNull(), 2)
        .when(F.col("target1_hit_at").isNotNull(), 1).otherwise(0)
    )
    out = out.withColumn("highest_target", highest)
    entered = F.col("ei").isNotNull()
    closed_window = F.coalesce(F.col("_seen") >= ENTRY_BARS, F.lit(False))
    expired = F.coalesce(F.col("_managed") >= MANAGED_BARS, F.lit(False))
    top = F.col("highest_target")
    result = (
        F.when(~F.col("_planned"), "PLAN_UNAVAILABLE")
        .when(~entered, F.when(closed_window, "NO_ENTRY").otherwise("WAITING_ENTRY"))
        .when(F.col("_stopped"), "STOPPED").when(top == 3, "H3_REACHED")
        .when(expired, F.concat(F.lit("EXPIRED_H"), top.cast("string")))
        .when(top > 0, F.concat(F.lit("H"), top.cast("string"), F.lit("_ACTIVE"))).otherwise("ENTRY_ACTIVE")
    )
    ordering = (
        F.when(~F.col("_planned") | ~entered, "NONE")
        .when(F.col("_stopped"), F.when(top == 0, "STOP_FIRST").otherwise(F.concat(F.lit("H"), top.cast("string"), F.lit("_THEN_STOP"))))
        .when(top > 0, "TARGET1_FIRST").otherwise("NONE")
    )
    terminal = (
        F.when(~F.col("_planned"), None)
        .when(~entered, F.when(closed_window, F.col("_window_end")))
        .when(F.col("_stopped"), F.col("_s.bar_ts")).when(top == 3, F.col("target3_hit_at"))
        .when(expired, F.col("_managed_end"))
    )
    return out.select(
        "signal_id", F.lit(2).alias("audit_version"), F.col("_entry_at").alias("entry_hit_at"),
        F.when(entered, F.least(F.greatest("_open", "zone_low"), F.col("zone_high"))).alias("entry_price"),
        F.when(F.col("_stopped"), F.col("_s.bar_ts")).alias("stop_hit_at"),
        "target1_hit_at", "target2_hit_at", "target3_hit_at",
        ordering.alias("ordering"), result.alias("result_classification"), "highest_target",
        F.col("ei").alias("bars_to_entry"), F.when(entered, F.col("_managed")).otherwise(0).cast("long").alias("bars_after_entry"),
        terminal.alias("terminal_at"),
    )


def upsert_outcomes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest outcome per (signal, horizon): fresh rows replace stored ones."""
    kept = stored.join(fresh.select("signal_id", "horizon"), ["signal_id", "horizon"], "left_anti")
    return kept.unionByName(fresh)


_FIRST_HITS = ("stop_hit_at", "target1_hit_at", "target2_hit_at", "target3_hit_at")


def merge_audits(stored: DataFrame, fresh: DataFrame, versioned: bool = True) -> DataFrame:
    """A versioned audit replaces all fields; a legacy one only fills missing first hits."""
    if versioned:
        return stored.join(fresh.select("signal_id"), "signal_id", "left_anti").unionByName(fresh)
    old, new = stored.alias("o"), fresh.alias("n")
    both = old.join(new, F.col("o.signal_id") == F.col("n.signal_id"), "full_outer")
    known = F.col("o.signal_id").isNotNull()
    columns = []
    for c in stored.columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in _FIRST_HITS or c == "signal_id":
            value = F.coalesce(was, now)
        elif c == "ordering":
            value = F.when(known & (was != "NONE"), was).otherwise(F.coalesce(now, was))
        elif c == "result_classification":
            value = F.coalesce(now, was)
        else:
            value = F.when(known, was).otherwise(now)
        columns.append(value.alias(c))
    return both.select(*columns)
