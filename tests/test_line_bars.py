"""Daily bars of regions and market from one scan of the order lines."""

import datetime as dt
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom import staging
from barloom.functions.bars import build_bars, merge_bars
from barloom.plans import sql
from barloom.sources import tables
from check_oracle import compare

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


@pytest.fixture
def orphans(tmp_path):
    """A small data set in which the first and last line of some days have no supplier."""
    for name in ("lineitem", "nation", "region"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SMALL}/supplier.parquet' WHERE s_suppkey % 3 <> 0) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("bars,parts,name", [(tables.day_bars, (sql.DAY,), "bars"), (tables.market_day_bars, (sql.LINES, sql.MARKET), "market")])
def test_bars_equal_sql_where_suppliers_are_missing(spark, orphans, bars, parts, name):
    """The market used to hold lines without a supplier, which its SQL leaves out."""
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{orphans}/{table}.parquet'")
    cursor = con.execute(sql.with_(*parts) + f"SELECT {', '.join(COLUMNS)} FROM {name}")
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    got = bars(spark, orphans).select(*COLUMNS)
    assert compare(got.columns, [tuple(row) for row in got.collect()], columns, want) == ""


def test_regions_and_market_share_a_scan(spark, orphans, monkeypatch):
    """Each of the two tables used to read all lines."""
    scans = []
    ticks = tables.line_ticks
    monkeypatch.setattr(tables, "line_ticks", lambda *args, **kw: scans.append(1) or ticks(*args, **kw))
    tables.day_bars(spark, orphans), tables.market_day_bars(spark, orphans)
    assert len(scans) == 1


def test_merged_bars_are_those_of_all_ticks(spark):
    start = dt.datetime(2001, 1, 1)
    rows = [("abc"[k * k % 3], start + dt.timedelta(hours=k % 60), k * 7 % 101, float(k * 13 % 17), float(k)) for k in range(101)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, volume double")
    want = build_bars(ticks.withColumn("symbol", F.lit("ALL")), "1d")
    got = merge_bars(build_bars(ticks, "1d", ends=True), "ALL")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_few_suppliers_are_joined_without_a_shuffle_of_lines(spark):
    """A join of suppliers with the names hid from Spark how small they are."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        assert "SortMergeJoin" not in tables.line_ticks(spark, LARGE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


def test_small_held_frames_have_few_partitions(spark):
    """A held frame used to keep every shuffle partition, empty ones too, so its tasks grew with that setting."""
    name = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        held = staging.hold(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
        assert {r["k"]: r["s"] for r in held.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
        assert held.select("*").rdd.getNumPartitions() < 10
        assert spark.conf.get(name) == before[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        staging.release()
