"""Lifecycle on a stream: every batch of bars moves the open setups on and appends their new events.

The state is a pair of small tables written with each batch: the setups still open, with the number of
events they have had, and the bars since the oldest open signal of their symbol.  A setup is settled
within some two dozen bars, so the state, and with it the cost of a batch, does not grow with history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import lifecycle
from barloom.operators.lifecycle import LEVELS, Policy
from barloom.sources.sinks import read_or_empty
from barloom.staging import hold, release

TERMINAL = (
    "CHASED", "NO_ENTRY", "EXPIRED", "CANCELLED_DECAY", "CANCELLED_STRUCTURE", "HARD_STOP", "TRAILING_STOP", "TIME_EXIT", "THESIS_INVALIDATED", "H3_REACHED",
)
SIGNAL = ("signal_id", "symbol", "bar_no", "ts", "rvol", *LEVELS)


def advance_setups(signals: Callable[[], DataFrame], path: str, policy: Policy = Policy()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink over bars with context columns and positions, which arrive in order of time.

    A batch reads its own bars, the signals of their time range and the state of the batch before.
    Evaluation is the batch form's, so each setup's events go on from the number that the state
    names.  A retried batch replaces its own folders and reads the same state again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = hold(batch)
        first, last = batch.agg(F.min("ts"), F.max("ts")).first()
        if last is None:
            first = last = "1970-01-01 00:00:00"
        new = signals().select(*SIGNAL).filter(F.col("ts").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
        new = new.withColumn("written", F.lit(0).cast("long"))
        before = batch_id - 1
        known = read_or_empty(spark, f"{path}/open_setups/batch_id={before}", new.schema)
        kept = read_or_empty(spark, f"{path}/open_bars/batch_id={before}", T.StructType(batch.schema.fields))
        live, bars = hold(known.unionByName(new)), hold(kept.unionByName(batch))
        # bars of the batch are complete; the rows of a setup end with them
        rows = hold(lifecycle.setup_bars(live.drop("written"), bars, F.lit(last).cast("timestamp") + F.expr("INTERVAL 15 MINUTES"), policy))
        log = hold(lifecycle.events(rows, live.drop("written"), policy))
        fresh = log.join(live.select("signal_id", "written"), "signal_id").filter(F.col("sequence") > F.col("written")).drop("written")
        fresh.write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
        states = log.groupBy("signal_id").agg(F.max_by("state_to", "sequence").alias("_state"), F.max("sequence").cast("long").alias("written"))
        still = live.drop("written").join(states, "signal_id").filter(~F.col("_state").isin(*TERMINAL)).drop("_state").select(*SIGNAL, "written")
        still.write.mode("overwrite").parquet(f"{path}/open_setups/batch_id={batch_id}")
        stored = read_or_empty(spark, f"{path}/open_setups/batch_id={batch_id}", new.schema)
        oldest = stored.groupBy("symbol").agg(F.min("bar_no").alias("_from"))
        bars.join(oldest, "symbol").filter(F.col("bar_no") > F.col("_from")).drop("_from").write.mode("overwrite").parquet(f"{path}/open_bars/batch_id={batch_id}")
        release()

    return apply
