"""Exact quantiles that never gather a group in one task.

Values are first collapsed to a histogram (group, value, count).  A monotone slice of the value
(its binary exponent and leading mantissa bits) gives small per-slice totals; the slice holding a
wanted rank is found from those and refined by radix selection, however concentrated the values are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.staging import hold

SLICES_PER_OCTAVE = 256
#: Parts of a refined bucket, different values that may be ordered in one task, and keys over which a bucket is dealt.
PARTS, LARGEST, SALTS = 1 << 14, 4096, 32


def value_slice(value: Column) -> Column:
    """Non-decreasing integer function of a double."""
    magnitude = F.floor((F.log2(F.abs(value)) + 1100) * SLICES_PER_OCTAVE) + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * magnitude)


def _ranks(n: Column, p: float, mode: str) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, weight of the upper one), 0-based."""
    if mode == "linear":
        at = (n - 1) * F.lit(p)
        low = F.floor(at)
        return low, F.least(low + 1, n - 1), at - low
    if mode == "upper":  # element n // 2 of the sorted values
        at = F.floor(n / 2)
        return at, at, F.lit(0.0)
    if mode == "nearest":  # half-even rounded position
        at = F.least(n - 1, F.bround((n - 1) * F.lit(p)).cast("long"))
        return at, at, F.lit(0.0)
    raise ValueError(mode)


def _holding(totals: DataFrame, within: list[str], before: Column, asks: Column) -> DataFrame:
    """The buckets that hold wanted ranks: by, bucket, its ends, its distinct values, the count before it, its asks.

    ``totals`` has a row for each bucket with ``_sc`` values; ``before`` is the count before the first of
    the neighbours that share ``within``.
    """
    upto = before + F.sum("_sc").over(Window.partitionBy(*within).orderBy("_bucket"))
    ranked = totals.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_sc"))
    wanted = F.filter(asks, lambda a: (a["r"] < F.col("_to")) & (a["r"] >= F.col("_from")))
    return ranked.withColumn("_asks", wanted).filter(F.size("_asks") > 0)


def _spread(frame: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that lie in a target bucket; a bucket's rows are dealt over ``SALTS`` keys, its one target row is copied to each."""
    copies = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return frame.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"]).drop("_salt")


def exact_quantiles(
    frame: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: Mapping[str, tuple[float, str]],
    largest: int = LARGEST,
) -> DataFrame:
    """One row per group with a column per wanted (probability, mode); null values are ignored.

    Radix selection: values fall into buckets by sign, exponent and leading bits, and only the buckets
    that hold a wanted rank are refined, each into ``PARTS`` parts between its least and greatest
    value, until none holds more than ``largest`` different values.  Those are ordered.
    """
    by = list(by) or ["_all"]
    base = frame.withColumn("_all", F.lit(0)) if by == ["_all"] else frame
    hist = hold(
        base.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bucket", value_slice(F.col("_v")))
    )

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum("_c").alias("_sc"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"))

    asks = []
    for name, (p, mode) in wanted.items():
        low, high, weight = _ranks(F.col("_n"), p, mode)
        asks += [
            F.struct(F.lit(name).alias("q"), low.cast("long").alias("r"), (1 - weight).cast("double").alias("f")),
            F.struct(F.lit(name).alias("q"), high.cast("long").alias("r"), F.lit(weight).cast("double").alias("f")),
        ]
    totals = counted(hist, *by, "_bucket").withColumn("_n", F.sum("_sc").over(Window.partitionBy(*by)))
    columns = [*by, "_bucket", "_least", "_greatest", "_distinct", "_from", "_asks"]
    targets = hold(_holding(totals, by, F.lit(0), F.array(*asks)).select(*columns))
    rows = _spread(hist, targets, [*by, "_bucket"])
    while (targets.agg(F.max("_distinct")).first()[0] or 0) > largest:
        width = F.col("_greatest") - F.col("_least")
        part = F.least(F.floor((F.col("_v") - F.col("_least")) / F.nullif(width, F.lit(0.0)) * PARTS), F.lit(PARTS - 1))
        parts = rows.select(*by, F.col("_least").alias("_parent"), F.coalesce(part, F.lit(0)).cast("long").alias("_bucket"), "_v", "_c")
        parents = targets.select(*by, F.col("_least").alias("_parent"), F.col("_from").alias("_before"), F.col("_asks").alias("_open"))
        inner = counted(parts, *by, "_parent", "_bucket").join(parents, [*by, "_parent"])
        targets = hold(_holding(inner, [*by, "_parent"], F.col("_before"), F.col("_open")).select("_parent", *columns))
        rows = _spread(parts, targets, [*by, "_parent", "_bucket"]).drop("_parent")
        targets = targets.drop("_parent")
    inside = Window.partitionBy(*by, "_least").orderBy("_v")
    hits = (
        rows.withColumn("_upto", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_ask", F.explode("_asks"))
        .filter((F.col("_ask.r") < F.col("_upto")) & (F.col("_ask.r") >= F.col("_upto") - F.col("_c")))
    )
    parts = F.col("_v") * F.col("_ask.f")
    out = hits.groupBy(*by).agg(
        *[F.sum(F.when(F.col("_ask.q") == name, parts)).alias(name) for name in wanted]
    )
    return out.drop("_all")
