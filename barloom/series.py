"""Skew-safe time-series layout.

A plain ``Window.partitionBy("symbol")`` puts the whole history of one symbol in one task, so a
symbol holding a third of the table becomes the job.  The helpers here never do that:

* ``number_bars`` gives every bar its dense position in its symbol.  Bars are counted per
  (symbol, time slice), the counts are summed over slices (one small row per slice), and only
  inside a slice are rows sorted.
* ``blocked`` cuts each symbol into blocks of ``size`` rows and copies the last ``halo`` rows of a
  block into the next one.  Any window function that looks back at most ``halo`` rows is exact when
  partitioned by (symbol, block), and all of them share one shuffle and one sort.
* ``running`` is a two-level prefix scan for unbounded running aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE_BARS = 1024
BLOCK_ROWS = 1024
HALO_ROWS = 32


def epoch_slice(ts: str | Column, seconds: int) -> Column:
    """Monotone slice id of an instant."""
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds * 1_000_000))


def number_bars(
    bars: DataFrame,
    step_seconds: int,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    name: str = "bar_no",
) -> DataFrame:
    """Dense 0-based position of each bar in its key, in time order.

    ``step_seconds`` is the bar interval: a slice spans SLICE_BARS intervals, so once identities are
    unique a (key, slice) group holds at most SLICE_BARS rows whatever the key's share of the data.
    """
    keys = list(keys)
    sliced = bars.withColumn("_slice", epoch_slice(ts, step_seconds * SLICE_BARS))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    before = counts.select(*keys, "_slice", (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts)
    return (
        sliced.withColumn("_at", F.row_number().over(inside) - 1)
        .join(before, [*keys, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_slice", "_at", "_before")
    )


@dataclass(frozen=True)
class Series:
    """Blocked bars plus the window that is exact for look-backs up to ``halo`` rows."""

    frame: DataFrame
    keys: tuple[str, ...]
    halo: int
    size: int

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_block").orderBy("bar_no")

    def last(self, n: int, offset: int = 0) -> WindowSpec:
        """The n rows ending ``offset`` rows before the current one."""
        if n + offset > self.halo + 1:
            raise ValueError(f"look-back {n + offset} exceeds halo {self.halo}")
        return self.w.rowsBetween(-(n - 1) - offset, -offset)

    def add(self, columns: Mapping[str, Column]) -> Series:
        return Series(self.frame.withColumns(dict(columns)), self.keys, self.halo, self.size)

    def rows(self) -> DataFrame:
        """Each input bar once, without the copied rows."""
        return self.frame.filter("_own").drop("_block", "_own")


def blocked(
    numbered: DataFrame,
    halo: int = HALO_ROWS,
    size: int = BLOCK_ROWS,
    keys: Sequence[str] = ("symbol",),
) -> Series:
    """Cut into blocks; a row also goes to each later block whose look-back reaches it."""
    home = F.floor(F.col("bar_no") / F.lit(size))
    reach = F.floor((F.col("bar_no") + F.lit(halo)) / F.lit(size))
    frame = (
        numbered.withColumn("_home", home)
        .withColumn("_block", F.explode(F.sequence(F.col("_home"), reach)))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )
    return Series(frame, tuple(keys), halo, size)


_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
}


def running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    slice_by: Column,
    folds: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Running aggregates per key from the first row to the current one, in two levels.

    ``slice_by`` must be non-decreasing along ``order``.  ``folds`` maps an output name to
    (input column, kind) with kind sum, max, min, product or last (last non-null value).
    """
    keys = list(keys) or ["_all"]
    base = frame if keys != ["_all"] else frame.withColumn("_all", F.lit(0))
    base = base.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carries = {}, [], []
    for name, (column, kind) in folds.items():
        if kind == "last":
            local[f"_in_{name}"] = F.last(column, ignorenulls=True).over(upto)
            totals.append(
                F.max(
                    F.when(
                        F.col(column).isNotNull(),
                        F.struct(*[_as_col(o) for o in order], F.col(column).alias("_v")),
                    )
                ).getField("_v").alias(f"_t_{name}")
            )
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            fn, _ = _FOLDS[kind]
            local[f"_in_{name}"] = fn(column).over(upto)
            totals.append(fn(column).alias(f"_t_{name}"))
            carries.append(fn(f"_t_{name}").over(earlier).alias(f"_c_{name}"))
    carry = base.groupBy(*keys, "_slice").agg(*totals).select(*keys, "_slice", *carries)
    out = base.withColumns(local).join(carry, [*keys, "_slice"])
    for name, (_, kind) in folds.items():
        mine, theirs = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        out = out.withColumn(name, F.coalesce(mine, theirs) if kind == "last" else _FOLDS[kind][1](theirs, mine))
    drop = ["_slice", *local, *[f"_c_{n}" for n in folds]] + (["_all"] if keys == ["_all"] else [])
    return out.drop(*drop)


def _as_col(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item

