"""Time-aware joins that stay equi-joins or scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.series import running


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], slice_by: Column,
    values: Sequence[str], ts: str = "ts", tie: str | None = None,
) -> DataFrame:
    """Every left row with the right row's ``values`` of the newest right time not after its own.

    Both sides go through one two-level scan per key; at equal times the right row comes first.
    ``tie`` names a left column that makes left rows of equal time distinct.
    """
    packed = F.struct(*[F.col(v) for v in values])
    pad = F.lit(None).cast(right.select(packed.alias("_v")).schema["_v"].dataType)
    others = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.struct(*others).alias("_row"), pad.alias("_v"), F.lit(1).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"))
    none = F.lit(None).cast(a.schema["_row"].dataType)
    b = right.select(*keys, ts, none.alias("_row"), packed.alias("_v"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"))
    scanned = running(a.unionByName(b), keys, [ts, "_side", "_tie"], slice_by, {"_last": ("_v", "last")})
    return scanned.filter(F.col("_side") == 1).select(*keys, ts, "_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def open_counts(intervals: DataFrame, stamps: DataFrame, start: str, end: str, slice_by: Column, ts: str = "ts") -> DataFrame:
    """How many intervals [start, end) contain each stamp; a null end is open.

    Starts and ends become +1 and -1 events; one scan over events and stamps gives the counts.
    """
    ins = intervals.groupBy(F.col(start).alias(ts)).agg(F.count(F.lit(1)).alias("_d"))
    outs = intervals.filter(F.col(end).isNotNull()).groupBy(F.col(end).alias(ts)).agg((-F.count(F.lit(1))).alias("_d"))
    marks = stamps.select(ts).distinct().withColumns({"_d": F.lit(0).cast("long"), "_mark": F.lit(1)})
    steps = ins.unionByName(outs).withColumn("_mark", F.lit(0)).unionByName(marks)
    per = steps.groupBy(ts).agg(F.sum("_d").alias("_d"), F.max("_mark").alias("_mark"))
    scanned = running(per, [], [ts], slice_by, {"open_positions": ("_d", "sum")})
    return scanned.filter(F.col("_mark") == 1).select(ts, "open_positions")
