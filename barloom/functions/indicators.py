"""Window indicators over a blocked ``Series``; every one is causal and null while warming up."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barloom.series import Series


def _full(value: Column, frame: WindowSpec, n: int, result: Column) -> Column:
    """Publish only when the frame holds n non-null values."""
    return F.when(F.count(value).over(frame) == n, result)


def sma(s: Series, value: Column, period: int) -> Column:
    frame = s.last(period)
    return _full(value, frame, period, F.avg(value).over(frame))


def lag(s: Series, value: Column, n: int = 1) -> Column:
    return F.lag(value, n).over(s.w)


def pct_change(s: Series, value: Column, n: int = 1) -> Column:
    return value / F.nullif(lag(s, value, n), F.lit(0.0)) - 1


def roc(s: Series, value: Column, period: int = 10) -> Column:
    return pct_change(s, value, period) * 100


def true_range(s: Series) -> Column:
    previous = lag(s, F.col("close"))
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )


def bollinger(s: Series, value: Column, period: int = 20, deviations: float = 2.0) -> dict[str, Column]:
    frame = s.last(period)
    middle = sma(s, value, period)
    spread = _full(value, frame, period, F.stddev_pop(value).over(frame)) * deviations
    return {"bb_lower": middle - spread, "bb_middle": middle, "bb_upper": middle + spread}


def relative_volume(s: Series, volume: Column, lookback: int = 20) -> Column:
    """Volume over the mean of the previous ``lookback`` rows, current row excluded."""
    frame = s.last(lookback, offset=1)
    mean = _full(volume, frame, lookback, F.avg(volume).over(frame))
    return volume / F.nullif(mean, F.lit(0.0))


def rolling_volatility(s: Series, returns: Column, period: int = 20) -> Column:
    """Population deviation of ``period`` one-row returns (a column already on the series)."""
    frame = s.last(period)
    return _full(returns, frame, period, F.stddev_pop(returns).over(frame))


def rolling_max(s: Series, value: Column, period: int, offset: int = 0) -> Column:
    frame = s.last(period, offset)
    return _full(value, frame, period, F.max(value).over(frame))


def rolling_min(s: Series, value: Column, period: int, offset: int = 0) -> Column:
    frame = s.last(period, offset)
    return _full(value, frame, period, F.min(value).over(frame))


def diff(s: Series, value: Column, n: int = 1) -> Column:
    return value - lag(s, value, n)


def close_quality() -> Column:
    """Where the close sits in the bar; the spread never falls below 1e-9."""
    return (F.col("close") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def rsi_from_means(gain: Column, loss: Column) -> Column:
    ratio = gain / F.nullif(loss, F.lit(0.0))
    return (
        F.when((loss == 0) & (gain > 0), F.lit(100.0))
        .when((loss == 0) & (gain == 0), F.lit(50.0))
        .otherwise(100 - 100 / (1 + ratio))
    )


def distance_percent(value: Column, base: Column) -> Column:
    return (value / F.nullif(base, F.lit(0.0)) - 1) * 100
