"""Feature tables: the daily one and the 15-minute one, per bar and at the last bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions import sessions
from barloom.functions.recursive import Mean, add_means, span_mean, wilder_mean
from barloom.series import Series

EMA_SPANS = (9, 12, 20, 26, 50, 200)

# Names of the daily features, in report order.
DAILY_FLAGS = (
    "price_above_ema20", "price_above_ema50", "price_above_ema200", "ema20_above_ema50",
    "ema50_above_ema200", "higher_high", "higher_low", "breakout",
)
DAILY_NUMBERS = (
    "ema20_slope", "ema50_slope", "rsi", "macd_histogram", "macd_slope", "roc", "rvol",
    "close_quality", "atr", "volatility", "recent_low",
)


def add_levels(s: Series, extra: Sequence[Mean] = (), totals: Sequence[str] = (), spans: Sequence[int] = EMA_SPANS) -> Series:
    """EMA levels, RSI, MACD and ATR in one pass over the blocks."""
    s = s.add({
        "tr": ind.true_range(s),
        "change": ind.diff(s, F.col("close")),
        "ret": ind.pct_change(s, F.col("close")),
    })
    s = s.add({"up": F.greatest("change", F.lit(0.0)), "down": -F.least("change", F.lit(0.0))})
    means = [span_mean(f"ema{p}", "close", p) for p in spans] + [
        wilder_mean("avg_gain", "up", 14, start=1),
        wilder_mean("avg_loss", "down", 14, start=1),
        wilder_mean("atr", "tr", 14),
        *extra,
    ]
    s = add_means(s, means, totals, macd=("ema12", "ema26", 9))
    return s.add({"rsi": ind.rsi_from_means(F.col("avg_gain"), F.col("avg_loss"))})


def daily_features(s: Series) -> Series:
    """The 19 daily features of every bar; comparisons with missing values are false."""
    s = add_levels(s)
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    flags = {
        "price_above_ema20": close > F.col("ema20"),
        "price_above_ema50": close > F.col("ema50"),
        "price_above_ema200": close > F.col("ema200"),
        "ema20_above_ema50": F.col("ema20") > F.col("ema50"),
        "ema50_above_ema200": F.col("ema50") > F.col("ema200"),
        "higher_high": high > ind.lag(s, high, 5),
        "higher_low": low > ind.lag(s, low, 5),
        "breakout": close > ind.rolling_max(s, high, 20, offset=1),
    }
    return s.add({
        **{name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()},
        "ema20_slope": ind.diff(s, F.col("ema20"), 5),
        "ema50_slope": ind.diff(s, F.col("ema50"), 5),
        "macd_slope": ind.diff(s, F.col("macd"), 3),
        "roc": ind.roc(s, close),
        "rvol": ind.relative_volume(s, F.col("volume")),
        "close_quality": ind.close_quality(),
        "volatility": ind.rolling_volatility(s, F.col("ret")),
        "recent_low": ind.rolling_min(s, low, 10, offset=1),
        "ret20": ind.pct_change(s, close, 20),
    })


def last_bar(frame: DataFrame) -> DataFrame:
    """The newest row of every symbol; times are unique within a symbol."""
    newest = frame.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return frame.join(newest, ["symbol", "ts"])


def add_benchmark_return(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Relative strength in percent points; a bar without a benchmark return is dropped."""
    side = market.filter(F.col("market_ret20").isNotNull()).select("ts", "market_ret20")
    return bars.join(side, "ts").withColumn(
        "relative_strength", (F.col("ret20") - F.col("market_ret20")) * 100
    )


def intraday_features(s: Series) -> DataFrame:
    """15-minute features per bar; needs 50 bars of history, earlier bars are left out."""
    s = add_levels(s, spans=(9, 12, 20, 26, 50))
    close = F.col("close")
    frame = s.last(20, offset=1)
    rolling = F.when(F.count("volume").over(frame) >= 5, F.avg("volume").over(frame))
    s = s.add({
        "prior_high": ind.rolling_max(s, F.col("high"), 20, offset=1),
        "roc": ind.roc(s, close, 4),
        "rolling_volatility": ind.rolling_volatility(s, F.col("ret")),
        "previous_volume": ind.lag(s, F.col("volume")),
        "volume_acceleration": ind.pct_change(s, F.col("volume")),
        "price_acceleration": ind.diff(s, F.col("ret")),
        "rolling_rvol": F.col("volume") / F.nullif(rolling, F.lit(0.0)),
        "low10": F.min("low").over(s.last(10)),
    })
    bars = s.rows()
    bars = sessions.add_slot_relative_volume(bars, fallback="rolling_rvol")
    bars = sessions.add_session_columns(bars)
    bars = sessions.add_previous_session_high(bars)
    distance = ind.distance_percent
    return bars.filter(F.col("bar_no") >= 49).withColumns({
        "rvol": F.coalesce("rvol", F.lit(1.0)),
        "vwap_distance": distance(close, F.col("session_vwap")),
        "ema9_distance": distance(close, F.col("ema9")),
        "ema20_distance": distance(close, F.col("ema20")),
        "ema50_distance": distance(close, F.col("ema50")),
        "breakout_distance": distance(close, F.col("prior_high")),
        "day_high_distance": distance(close, F.col("session_high")),
        "previous_day_high_distance": F.coalesce(
            distance(close, F.col("previous_session_high")), F.lit(0.0)
        ),
    })
