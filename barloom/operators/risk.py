"""Stops, targets, sizing and research trade plans as row expressions.

Where inputs are unusable the result is null (and a plan is marked invalid) instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Risk parameters of the published plans.
ATR_MULTIPLIER = 1.2
FIRST_TARGET_R, SECOND_TARGET_R, THIRD_TARGET_R = 1.5, 2.5, 3.0
DAILY_RISK_REWARD = 2.5
RISK_PERCENT = 0.75
MAX_POSITION_PERCENT = 20.0
MIN_STOP_DISTANCE_PERCENT = 0.10
PLAN_INVALID = "GECERSIZ"
PLAN_CHASED = "KACMIS_KOVALAMA"
PLAN_BREAKOUT = "BREAKOUT_ONAYI"
PLAN_IN_ZONE = "GIRIS_BOLGESINDE"
PLAN_WAITING = "GIRIS_BEKLENIYOR"
EQUITY = 100_000.0


def stop_price(entry: Column, atr: Column, swing: Column, multiplier: float = ATR_MULTIPLIER) -> Column:
    """Lower of the swing low and entry minus 1.2 ATR, to the cent; null when not a valid stop."""
    raw = F.least(swing, entry - atr * multiplier)
    usable = (entry > 0) & (atr > 0) & (swing > 0) & (raw > 0) & (raw < entry)
    return F.when(usable, F.bround(raw, 2))


def add_trade_plan(frame: DataFrame, entry: str = "close", atr: str = "atr", swing: str = "recent_low") -> DataFrame:
    """``entry``, ``stop``, ``target_1``, ``target_2`` and ``risk_reward`` (null without a valid stop)."""
    price = F.col(entry)
    out = frame.withColumn("stop", stop_price(price, F.col(atr), F.col(swing)))
    risk = price - F.col("stop")
    return out.withColumns({
        "entry": price,
        "target_1": F.bround(price + risk * FIRST_TARGET_R, 2),
        "target_2": F.bround(price + risk * SECOND_TARGET_R, 2),
        "risk_reward": F.when(F.col("stop").isNotNull(), F.lit(DAILY_RISK_REWARD)),
    })


def position_size(
    equity: Column, entry: Column, stop: Column,
    risk_percent: float = RISK_PERCENT, max_percent: float = MAX_POSITION_PERCENT,
) -> Column:
    """Whole shares within the risk budget and the position cap; null for unusable stops."""
    distance = entry - stop
    usable = (
        (equity > 0) & (entry > 0) & (stop > 0) & (distance > 0)
        & (distance / entry * 100 >= MIN_STOP_DISTANCE_PERCENT)
    )
    by_risk = F.floor(equity * risk_percent / 100 / distance)
    by_cap = F.floor(equity * max_percent / 100 / entry)
    return F.when(usable, F.least(by_risk, by_cap))


def add_research_plan(
    candidates: DataFrame, swing: str = "low10", equity: float = EQUITY,
    risk_percent: float = RISK_PERCENT, max_percent: float = MAX_POSITION_PERCENT,
) -> DataFrame:
    """Adds the struct column ``plan``: zone, stop, targets, status and sizing.

    Reads price, atr, breakout_distance and the lowest of the last ten lows.
    """
    price, atr = F.col("price"), F.col("atr")
    base = candidates.withColumn(
        "_breakout", price * (1 + F.coalesce(F.col("breakout_distance"), F.lit(0.0)) / 100)
    ).withColumns({
        "_low": F.col("_breakout") - atr * 0.25,
        "_high": F.col("_breakout") + atr * 0.10,
    }).withColumn("_entry", (F.col("_low") + F.col("_high")) / 2)
    base = base.withColumn(
        "_stop", F.when(price > 0, stop_price(F.col("_entry"), atr, F.col(swing)))
    ).withColumn("_size", position_size(F.lit(equity), F.col("_entry"), F.col("_stop"), risk_percent, max_percent))
    entry, stop = F.col("_entry"), F.col("_stop")
    risk = entry - stop
    status = (
        F.when(F.col("_size").isNull() | (price <= stop), PLAN_INVALID)
        .when(price > F.col("_high") + atr * 0.5, PLAN_CHASED)
        .when(price >= F.col("_breakout"), PLAN_BREAKOUT)
        .when((price >= F.col("_low")) & (price <= F.col("_high")), PLAN_IN_ZONE)
        .otherwise(PLAN_WAITING)
    )

    def target(multiple: float) -> Column:
        level = entry + risk * multiple
        return F.struct(
            F.bround(level, 2).alias("price"),
            F.bround((level / entry - 1) * 100, 2).alias("return_percent"),
        )

    complete = F.struct(
        status.alias("status"),
        F.bround(price, 2).alias("reference_price"),
        F.bround("_low", 2).alias("entry_zone_low"),
        F.bround("_high", 2).alias("entry_zone_high"),
        F.bround("_breakout", 2).alias("breakout_trigger"),
        stop.alias("stop_price"),
        F.bround(risk / entry * 100, 2).alias("stop_distance_percent"),
        F.array(*[target(m) for m in (FIRST_TARGET_R, SECOND_TARGET_R, THIRD_TARGET_R)]).alias("targets"),
        F.bround(F.lit(SECOND_TARGET_R), 2).alias("risk_reward"),
        F.struct(
            F.lit(equity).alias("account_equity"),
            F.lit(risk_percent).alias("max_risk_percent"),
            F.lit(equity * risk_percent / 100).alias("allowed_risk_amount"),
            F.bround(F.col("_size") * entry, 2).alias("suggested_position_value"),
            F.col("_size").cast("long").alias("estimated_quantity"),
        ).alias("position_sizing"),
    )
    # An unusable plan keeps only its status.
    out = base.withColumn("_complete", complete)
    out = out.withColumn("plan_status", F.col("_complete.status"))
    out = out.withColumn("plan", F.when(F.col("_size").isNotNull(), F.col("_complete")))
    return out.drop("_breakout", "_low", "_high", "_entry", "_stop", "_size", "_complete")


def plan_levels(frame: DataFrame) -> DataFrame:
    """Flat numeric levels of the plan, as labels and the lifecycle read them."""
    return frame.withColumns({
        "zone_low": F.least("plan.entry_zone_low", "plan.entry_zone_high"),
        "zone_high": F.greatest("plan.entry_zone_low", "plan.entry_zone_high"),
        "stop": F.col("plan.stop_price"),
        "t1": F.col("plan.targets")[0]["price"],
        "t2": F.col("plan.targets")[1]["price"],
        "t3": F.col("plan.targets")[2]["price"],
    })
