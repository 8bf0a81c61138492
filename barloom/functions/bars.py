"""Tumbling OHLCV bars from ticks (batch or stream)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.schema import TIMEFRAME_SECONDS


def arrival_order(ts: Column, tie: Column) -> Column:
    """Arrival order inside any bar of up to a day as one decimal.

    The microsecond of the day stands above the whole 64 bits of ``tie``, a long that orders ticks of
    the same microsecond.  A fixed-width key keeps the bar aggregate a hash aggregate; a struct would
    turn it into a sort of all ticks.
    """
    micros = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)).cast("decimal(11,0)")
    return micros * F.lit(str(2**64)).cast("decimal(20,0)") + tie.cast("long").cast("decimal(19,0)")


def packed_order(ranges: Mapping[str, tuple[int | None, int | None]]) -> Column:
    """Whole-number columns, the first one counting most and nulls first, as one number.

    ``ranges`` has the least and greatest value of each column (None without values).  Positions inside the ranges are
    the digits of a long or, where they need more, of a decimal; both keep the bar aggregate a hash
    aggregate.  Columns too wide for a decimal stay a struct, for which all ticks are sorted.
    """
    widths = {c: 1 if low is None else high - low + 2 for c, (low, high) in ranges.items()}
    places = math.prod(widths.values())
    if places >= 10**38:
        return F.struct(*ranges)
    kind = "long" if places < 2**63 else "decimal(38,0)"

    def number(value: int) -> Column:
        return F.lit(str(value)).cast(kind)

    out = number(0)
    for name, (low, _) in ranges.items():
        digit = number(0) if low is None else F.coalesce(F.col(name).cast(kind) - number(low) + number(1), number(0))
        out = (out * number(widths[name]) + digit).cast(kind)
    return out


def build_bars(ticks: DataFrame, timeframe: str, watermark: str | None = None, ends: bool = False) -> DataFrame:
    """symbol, ts, open, high, low, close, volume per timeframe.

    Ticks carry symbol, ts, price, volume and ``seq``, any value that orders the ticks of a bar.  With ``ends`` a bar
    keeps the ``seq`` of its first and last tick, so that ``merge_bars`` can put bars together.

    ``watermark`` (for example "15 minutes") makes the same plan append-only on a stream: a bar is
    emitted once its interval plus the delay has passed.
    """
    width = TIMEFRAME_SECONDS[timeframe]
    if watermark:
        ticks = ticks.withWatermark("ts", watermark)
    slot = F.window("ts", f"{width} seconds")
    kept = {"first_seq": F.min("seq"), "last_seq": F.max("seq")} if ends else {}
    bars = ticks.groupBy("symbol", slot.alias("slot")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
        *[value.alias(name) for name, value in kept.items()],
    )
    return bars.select(
        "symbol", F.col("slot.start").alias("ts"), "open", "high", "low", "close", "volume", *kept
    )


def merge_bars(bars: DataFrame, symbol: str) -> DataFrame:
    """Bars of ``symbol`` from all ``bars`` of the same time, built with ``ends``: as if from their ticks."""
    return bars.groupBy(F.lit(symbol).alias("symbol"), "ts").agg(
        F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"), F.sum("volume").alias("volume"),
    )
