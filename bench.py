"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from barloom.plans.catalog import queries
from barloom.session import build_session
from barloom.staging import forget

HEADLINES = (
    "st01_bars_15m", "st01_bars_60m_by_user", "st01_bars_1d", "ts01_sma", "ts02_ema", "ts04_macd",
    "ts18_slot_relative_volume", "f01_feature_table", "f05_score", "f07_intraday_features", "f11_classify_text",
    "v01_validate_raw_series", "in02_ingest_metrics", "in06_dataset_hash", "l01_l03_labels", "l06_level_audit",
    "t05_exits", "t08_equity_curve", "a05_bucket_analytics", "a11_trade_metrics", "st04_cooldown",
    "st06_lifecycle", "m05_logistic_heads", "m09_classification_metrics", "st02_stream_bars", "st04_stream_cooldown",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered = queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    timings: dict[str, float] = {}
    for name in HEADLINES:
        if name not in registered:
            continue
        forget(spark)  # every query pays for its own inputs
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
