"""Stored tables and the shared folder."""

import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.operators import trades
from barloom.staging import staged


def test_changed_input_is_built_again(spark, tmp_path):
    build = lambda: spark.read.parquet(f"{tmp_path}/a").agg(F.sum("id").alias("s"))
    spark.range(5).write.parquet(f"{tmp_path}/a")
    assert staged("sums", spark, str(tmp_path), build).first()["s"] == 10
    first = staged("sums", spark, str(tmp_path), build)
    assert staged("sums", spark, str(tmp_path), build) is first
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert staged("sums", spark, str(tmp_path), build).first()["s"] == 21


class _Cluster:
    """As much of a session on a cluster as the check looks at."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class sparkContext:  # noqa: N801
        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Missing:
                            @staticmethod
                            def isDefined():
                                return False
                        return Missing
                return Context


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Cluster)


def test_far_exits_over_many_blocks(spark, monkeypatch):
    """Exits thousands of blocks away, found through the levels, equal those of a plain search."""
    monkeypatch.setattr(trades, "FAN", 4)
    bars = spark.range(3000).select(
        F.lit("A").alias("symbol"), F.col("id").alias("bar_no"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(100.0).alias("open"),
        F.when(F.col("id").isin(700, 2999), 110.0).otherwise(101.0).alias("high"), F.when(F.col("id") == 1500, 90.0).otherwise(99.0).alias("low"))
    rows = [(f"t{b}", "A", b, 95.0, 105.0, 120.0) for b in (0, 5, 690, 699, 700, 1200, 1499, 1500, 2998, 2999)]
    frame = spark.createDataFrame(rows, "trade_id string, symbol string, entry_bar long, stop double, target_1 double, target_2 double")
    got = {r["trade_id"]: int(r["exit_time"].timestamp()) // 60 for r in trades.first_exits(frame, bars, block=8).collect()}
    want = {}
    for name, _, entry, *_ in rows:
        later = [b for b in (700, 1500, 2999) if b > entry]
        if later:
            want[name] = later[0]
    assert got == want
