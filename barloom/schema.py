"""Explicit schemas for the boundary tables, and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()
_TS = T.TimestampType()
MONEY = T.DecimalType(20, 8)


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


BAR_CSV = _struct(
    ("symbol", _S), ("timestamp", _TS),
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D),
)

CANONICAL_BAR = _struct(
    ("symbol", _S), ("ts", _TS), ("timeframe", _S),
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D),
    ("provider", _S), ("received_at", _TS), ("is_adjusted", T.BooleanType()),
    ("adjustment_type", _S), ("quality_flags", T.ArrayType(_S)), ("ingest_seq", T.LongType()),
)

UNIVERSE_CSV = _struct(
    ("symbol", _S), ("name", _S), ("sector", _S), ("active", _S), ("source", _S), ("source_date", _S),
)

# Vendor A names its fields shortly and sends ISO times; vendor B sends epoch seconds.
VENDOR_A = _struct(
    ("ticker", _S), ("time", _S), ("interval", _S),
    ("o", _S), ("h", _S), ("l", _S), ("c", _S), ("v", _S),
)
VENDOR_B = _struct(
    ("instrument", _S), ("ts", _S), ("tf", _S),
    ("openPrice", _S), ("highPrice", _S), ("lowPrice", _S), ("lastPrice", _S), ("totalVolume", _S),
)

IDENTITY = ("provider", "symbol", "timeframe", "ts")
VALUES = ("open", "high", "low", "close", "volume")

# Seconds per timeframe label.
TIMEFRAME_SECONDS = {"1d": 86400, "60m": 3600, "30m": 1800, "15m": 900, "5m": 300}
# Age in seconds beyond which the last bar counts as stale. 30m is our addition.
STALE_SECONDS = {"5m": 600, "15m": 1800, "30m": 3600, "60m": 7200, "1d": 172800}
DELAYED_ALLOWANCE_SECONDS = 1200

# Trading calendar of the covered exchange.
EXCHANGE_ZONE = "Europe/Istanbul"
