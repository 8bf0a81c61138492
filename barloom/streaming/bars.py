"""Bars from a tick stream: the batch plan with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.bars import build_bars
from barloom.schema import IDENTITY


def stream_bars(ticks: DataFrame, timeframe: str, delay: str = "15 minutes") -> DataFrame:
    """Append-only bars: a bar appears once its interval plus the delay has passed."""
    return build_bars(ticks, timeframe, watermark=delay)


def first_copies(bars: DataFrame, delay: str = "2 days") -> DataFrame:
    """First copy of each bar identity within the overlap that is downloaded again."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(IDENTITY))


def write_once(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to Parquet, exactly once, and stop."""
    return (
        frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def with_event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times are UTC; a watermark needs them as instants."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))
