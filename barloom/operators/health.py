"""Run-length health of a provider and legality of order state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.series import running

# Allowed state changes of an order.
TRANSITIONS = {
    "SIGNAL_CREATED": ("PENDING_ENTRY", "REJECTED", "CANCELLED"),
    "PENDING_ENTRY": ("OPEN", "REJECTED", "CANCELLED"),
    "OPEN": ("PARTIALLY_EXITED", "CLOSED"),
    "PARTIALLY_EXITED": ("CLOSED",),
    "CLOSED": (),
    "CANCELLED": (),
    "REJECTED": (),
}
FAILURES_DOWN, SUCCESSES_HEALTHY = 3, 2


def provider_health(log: DataFrame, keys: list[str], order: list[str], slice_by: Column, ok: str = "ok") -> DataFrame:
    """State after every call: DOWN from the third failure in a row, DEGRADED before, HEALTHY from
    the second success in a row; a lone success keeps the state before it.

    The length of the current streak is the distance to the last opposite result, found with a
    two-level scan.
    """
    base = log.withColumns({
        "_one": F.lit(1), "_pos": F.lit(1),
    })
    numbered = running(base, keys, order, slice_by, {"call_no": ("_one", "sum")})
    marked = numbered.withColumns({
        "_fail_no": F.when(~F.col(ok), F.col("call_no")), "_good_no": F.when(F.col(ok), F.col("call_no")),
    })
    seen = running(marked, keys, order, slice_by, {"_last_fail": ("_fail_no", "max"), "_last_good": ("_good_no", "max")})
    streak_good = F.col("call_no") - F.coalesce("_last_fail", F.lit(0))
    streak_bad = F.col("call_no") - F.coalesce("_last_good", F.lit(0))
    direct = (
        F.when(~F.col(ok), F.when(streak_bad >= FAILURES_DOWN, "DOWN").otherwise("DEGRADED"))
        .when(streak_good >= SUCCESSES_HEALTHY, "HEALTHY")
    )
    stated = seen.withColumn("_direct", direct)
    out = running(stated, keys, order, slice_by, {"_carried": ("_direct", "last")})
    return out.withColumn("health", F.coalesce("_carried", F.lit("UNKNOWN"))).drop(
        "_one", "_pos", "_fail_no", "_good_no", "_last_fail", "_last_good", "_direct", "_carried"
    )


def illegal_changes(states: DataFrame, key: str = "order_id", order: str = "seq", state: str = "state") -> DataFrame:
    """Consecutive states of one order that the table does not allow (an order has a few states)."""
    pairs = F.array(*[
        F.concat_ws(">", F.lit(a), F.lit(b)) for a, targets in TRANSITIONS.items() for b in targets
    ])
    over = Window.partitionBy(key).orderBy(order)
    stepped = states.withColumn("previous", F.lag(state, 1, "SIGNAL_CREATED").over(over)).withColumn(
        "_first", F.row_number().over(over) == 1
    )
    change = F.concat_ws(">", "previous", state)
    start = F.col("_first") & (F.col(state) == "SIGNAL_CREATED")
    return stepped.filter(~start & ~F.array_contains(pairs, change)).drop("_first")
