"""Small helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import TIMEFRAME_SECONDS
from barloom.series import Series, blocked, number_bars
from barloom.sources import tables


def rnd(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles so that summation order does not show."""
    return frame.withColumns({c: F.round(F.col(c), digits) for c in columns})


def r(column: str | Column, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits)


def series(bars: DataFrame, timeframe: str, halo: int = 32) -> Series:
    """Blocked series of bars that may carry their positions already."""
    if "bar_no" not in bars.columns:
        bars = number_bars(bars, TIMEFRAME_SECONDS[timeframe])
    return blocked(bars, halo)


def m15_series(spark: SparkSession, folder: str, halo: int = 32) -> Series:
    return series(tables.m15_bars(spark, folder), "15m", halo)


def day_series(spark: SparkSession, folder: str, halo: int = 32) -> Series:
    return series(tables.day_bars(spark, folder), "1d", halo)
