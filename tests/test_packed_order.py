"""Order of ticks by several whole-number columns as one number."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.bars import build_bars, packed_order
from barloom.sources import tables

NAMES = ("a", "b", "c")


def ranges(rows):
    return {n: (min(v, default=None), max(v, default=None)) for n, v in zip(NAMES, ([r[k] for r in rows if r[k] is not None] for k in range(3)))}


@pytest.mark.parametrize("wide,kind", [(9, "bigint"), (2**40, "decimal(38,0)"), (2**62, "struct")])
def test_order_is_that_of_the_columns(spark, wide, kind):
    pick = random.Random(wide)
    near = [-wide, -1, 0, 1, wide, None]
    rows = [tuple(pick.choice(near) for _ in range(3)) for _ in range(150)] + [(wide, wide, wide), (-wide, -wide, -wide)]
    frame = spark.createDataFrame(rows, "a long, b long, c long").withColumn("key", packed_order(ranges(rows)))
    assert dict(frame.dtypes)["key"].split("<")[0] == kind
    got = [tuple(r)[:3] for r in frame.orderBy("key").collect()]
    assert got == sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))
    assert frame.select("key").distinct().count() == len(set(rows))


def test_no_values(spark):
    rows = [(None, 3, None), (None, None, None), (None, 1, None)]
    frame = spark.createDataFrame(rows, "a long, b long, c long").withColumn("key", packed_order(ranges(rows)))
    assert [r["b"] for r in frame.orderBy("key").collect()] == [None, 1, 3]


def test_line_bars_do_not_sort_ticks(spark):
    """All ticks of a task used to be sorted, since their order was a struct."""
    folder = "/root/testdata/sf0.001"
    for ticks in (tables.line_ticks(spark, folder), tables.line_ticks(spark, folder, market_wide=True), tables.contract_ticks(spark, folder)):
        plan = build_bars(ticks, "1d")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_lines_of_equal_order_and_number(spark, tmp_path):
    """The part decides the first and last trade where order and line number are the same."""
    day = dt.datetime(1996, 1, 1)
    rows = [(7, 5, 0, 1, 2.0, 40.0, day), (7, 3, 0, 1, 2.0, 60.0, day), (7, 9, 0, 1, 2.0, 20.0, day)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    bar = build_bars(tables.line_ticks(spark, str(tmp_path), market_wide=True), "1d").select(F.round("open", 6), F.round("close", 6)).first()
    assert tuple(bar) == (100.03, 100.01)
