"""Accepted-only cooldown on a stream: signals wait until no earlier one can come, state expires.

Signals of a (symbol, timeframe) wait in steps of event time.  Once the watermark has passed the end of
a step, a timer decides its signals in order, so arrival order does not matter within the delay.  What
arrives for a step already decided is late: it is reported as such and changes nothing.  The last
accepted signal leaves the state when its cooldown is over, so a key without signals keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.cooldown import UPGRADE_POINTS

DECISION = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("score", T.LongType()), T.StructField("decision", T.StringType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "LATE"
#: How late a signal may be and still be reported; Spark itself drops older ones and counts them.
HORIZON_DAYS = 30


class Cooldown(StatefulProcessor):
    """Keeps the waiting signals of each step, and time and score of the last accepted one.

    Memory is bounded by one chunk of input and by the signals of one step of a key.
    """

    def __init__(self, minutes: int = 60, points: int = UPGRADE_POINTS, step_minutes: int = 60) -> None:
        self.cooldown, self.points, self.step = minutes * 60_000_000, points, step_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.LongType()
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", number), T.StructField("score", number)]))
        self.waiting = handle.getMapState(
            "waiting", T.StructType([T.StructField("until", number)]),
            T.StructType([T.StructField("times", T.ArrayType(number)), T.StructField("scores", T.ArrayType(number))]))

    def _rows(self, key: Any, times: list[int], scores: list[int | None], decisions: list[str]) -> pd.DataFrame:
        return pd.DataFrame({
            "symbol": key[0], "timeframe": key[1], "ts": pd.to_datetime(pd.Series(times, dtype="int64"), unit="us"),
            "score": pd.Series(scores, dtype="Int64"), "decision": decisions,
        })

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for chunk in rows:
            t = chunk["ts"].astype("datetime64[us]").astype("int64")
            until = (t // 1000 // self.step + 1) * self.step
            late = until <= mark
            if late.any():
                yield self._rows(key, t[late].tolist(), chunk["score"][late].tolist(), [LATE] * int(late.sum()))
            fresh = pd.DataFrame({"until": until, "t": t, "score": chunk["score"].astype("int64")})[~late]
            for end, part in fresh.groupby("until"):
                at = (int(end),)
                times, scores = part["t"].tolist(), part["score"].tolist()
                if self.waiting.containsKey(at):
                    held = self.waiting.getValue(at)
                    times, scores = [*held[0], *times], [*held[1], *scores]
                else:
                    self.handle.registerTimer(int(end))
                self.waiting.updateValue(at, (times, scores))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self.last.get() if self.last.exists() else None
        at = (int(now),)
        if self.waiting.containsKey(at):
            times, scores = self.waiting.getValue(at)
            self.waiting.removeKey(at)
            order = sorted(range(len(times)), key=lambda i: (times[i], -scores[i]))
            decisions, before, first = [], None, held
            for i in order:
                t, score = times[i], scores[i]
                if t == before:
                    decisions.append("REJECTED_DUPLICATE")
                    continue
                before = t
                recent = held is not None and t - held[0] <= self.cooldown
                if recent and score < held[1] + self.points:
                    decisions.append("REJECTED_COOLDOWN")
                    continue
                decisions.append("SIGNAL_UPGRADED" if recent else "SIGNAL_CREATED")
                held = (int(t), int(score))
            if held != first:
                self.last.update(held)
                # a step's end as well, so that steps and expiry share their timers
                self.handle.registerTimer(int(((held[0] + self.cooldown) // 1000 // self.step + 1) * self.step))
            yield self._rows(key, [times[i] for i in order], [scores[i] for i in order], decisions)
        if held is not None and held[0] + self.cooldown < now * 1000:
            self.last.clear()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with several variables lives in RocksDB, on local disk with remote snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_decisions(
    signals: DataFrame, minutes: int = 60, points: int = UPGRADE_POINTS, delay_minutes: int = 180, step_minutes: int = 60,
) -> DataFrame:
    """symbol, timeframe, ts, score and decision of a signal stream.

    A signal is decided once the newest signal of the stream is ``delay_minutes`` later than the end of
    its step.  The decision of one that comes after that is LATE.  Signals of one time are decided once,
    the highest score first, the others are REJECTED_DUPLICATE.  A row without a score is left out.
    """
    use_rocksdb(signals.sparkSession)
    # The watermark runs on a shifted time: signals later than the delay still reach the processor, which knows them as late.
    shifted = signals.filter(F.col("score").isNotNull()).select(
        "symbol", "timeframe", "ts", F.col("score").cast("long").alias("score"), F.col("ts").alias("_mark"))
    shifted = shifted.withColumn("_mark", F.col("_mark") + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS"))
    marked = shifted.withWatermark("_mark", f"{HORIZON_DAYS * 1440 + delay_minutes} minutes")
    return marked.groupBy("symbol", "timeframe").transformWithStateInPandas(
        statefulProcessor=Cooldown(minutes, points, step_minutes), outputStructType=DECISION, outputMode="Append", timeMode="EventTime",
    )
