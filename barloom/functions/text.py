"""Text rendering that matches exact binary rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = 2**52


def two_decimals(value: Column) -> Column:
    return decimals(value, 2)


def decimals(value: Column, places: int) -> Column:
    """``value`` with up to three decimals, rounding the exact binary value half to even.

    The JVM formatter rounds the shortest decimal text half up, so 0.825 would become 0.83 although
    the double lies below it.  The fraction is taken as 52 bits and 26 bits below them, which hold
    every bit that can decide a rounding; from 2 ** 52 on a double has no fraction.
    """
    factor = 10**places
    size = F.abs(value)
    scaled = (size - F.floor(size)) * float(_UNIT)
    below = F.floor((scaled - F.floor(scaled)) * float(2**26)) * factor
    parts = F.struct(
        F.floor(size).alias("whole"), (F.floor(scaled) * factor + F.shiftright(below, 26)).alias("fraction"),
        below.bitwiseAND(F.lit(2**26 - 1)).alias("low"),
    )

    def cents(x: Column) -> Column:
        own = F.shiftright(x["fraction"], 52)
        rest = x["fraction"].bitwiseAND(F.lit(_UNIT - 1))
        up = (rest > _UNIT // 2) | ((rest == _UNIT // 2) & ((x["low"] > 0) | (own % 2 == 1)))
        return x["whole"] * factor + own + up.cast("long")

    def text(x: Column) -> Column:
        if not places:
            return x.cast("string")
        return F.concat(F.floor(x / factor).cast("string"), F.lit("."), F.lpad((x % factor).cast("string"), places, "0"))

    # one-element arrays name the steps, so that no step is written out twice
    digits = F.transform(F.transform(F.array(parts), cents), text)[0]
    exact = size < float(_UNIT)
    return F.when(value.isNull() | F.isnan(value), "nan").when(
        exact, F.concat(F.when(value < 0, "-").otherwise(""), digits)
    ).otherwise(F.format_string(f"%.{places}f", value))


def six_digits(value: Column) -> Column:
    """``value`` with six significant digits and no trailing zeros, for sizes from 1 to below a million."""
    out = value.cast("string")
    for whole in range(6, 0, -1):
        fits = F.abs(value) < 10**whole - 0.5 * 10.0 ** (whole - 6)
        out = F.when(fits, F.format_string(f"%.{6 - whole}f", value)).otherwise(out)
    return F.when(out.contains("."), F.regexp_replace(out, r"\.?0+$", "")).otherwise(out)
