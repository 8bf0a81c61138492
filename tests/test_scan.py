"""Research scan: tails as of a moment against plain Python, and every refusal."""

import datetime as dt

import numpy as np
import pandas as pd

from barloom.operators import lifecycle, scan
from barloom.series import number_bars

DAY = dt.timedelta(days=1)
START = dt.datetime(2020, 1, 1)


def bars(symbol, days, price, rng):
    close = price + np.cumsum(rng.normal(0.05, 1, len(days))) * (price != 1000)
    return pd.DataFrame({
        "symbol": symbol, "ts": [START + d * DAY for d in days], "open": close, "high": close + (price != 1000), "low": close - (price != 1000),
        "close": close, "volume": rng.integers(100, 200, len(days)).astype(float)})


def test_tails(spark):
    rng = np.random.default_rng(1)
    index = bars("INDEX", [d for d in range(900) if d % 7], 500, rng)
    numbered = number_bars(spark.createDataFrame(index), 86400)
    stamps = [-5, 0, 1, 7, 13, 300, 301, 899, 2000]
    frame = spark.createDataFrame([(START + s * DAY,) for s in stamps], "ts timestamp")
    got = scan.tails_as_of(frame, numbered, 86400).toPandas()
    for s in stamps:
        upto = index[index.ts <= START + s * DAY]
        tail = got[got.stamp == START + s * DAY].sort_values("bar_no")
        assert tail.ts.tolist() == upto.tail(scan.WINDOW).ts.tolist()
        assert tail.bar_no.tolist() == list(range(len(tail))) and (tail.bars == len(upto)).all()
    mine = scan.tails(numbered).toPandas().sort_values("bar_no")
    assert mine.ts.tolist() == index.tail(scan.WINDOW).ts.tolist() and (mine.bars == len(index)).all()


def test_refusals(spark):
    rng = np.random.default_rng(2)
    table = pd.concat([
        bars("SHORT", range(600, 700), 50, rng), bars("EARLY", range(0, 260), 50, rng), bars("STILL", range(300, 700), 1000, rng),
        bars("LIVE", range(0, 700), 50, rng), bars("OTHER", range(100, 650), 80, rng)])
    index = bars("INDEX", range(200, 700), 500, rng)
    numbered, other = (number_bars(spark.createDataFrame(t), 86400) for t in (table, index))
    out = scan.research_scan(numbered, other, 86400)
    rows = {r["symbol"]: r for r in out.collect()}
    assert rows["SHORT"]["refusal"] == scan.WARMUP and rows["EARLY"]["refusal"] == scan.NO_INDEX and rows["STILL"]["refusal"] == scan.NO_PLAN
    assert all(rows[s]["score"] is None for s in ("SHORT", "EARLY", "STILL"))
    for s in ("LIVE", "OTHER"):
        r = rows[s]
        assert r["score"] is not None and (r["refusal"] == scan.LOW) == (r["score"] < scan.ORDER_SCORE) and r["stop"] < r["target_1"] < r["target_2"]
    assert rows["OTHER"]["index_bars"] == 450 and rows["LIVE"]["index_bars"] == 500
    tally = {r["refusal"]: r["symbols"] for r in scan.refusals(out).collect()}
    assert sum(tally.values()) == sum(r["refusal"] is not None for r in rows.values())
    none = scan.research_scan(numbered, other.limit(0), 86400)
    assert {r["refusal"] for r in none.collect()} == {scan.WARMUP, scan.NO_INDEX}


def test_plan_versions(spark):
    """Each event lies in exactly one version; the event that moves the stop begins the next."""
    t = lambda k: START + dt.timedelta(minutes=15 * k)
    log = spark.createDataFrame(
        [("s", k + 1, t(k), e, r, p) for k, (e, r, p) in enumerate([
            ("SIGNAL_DETECTED", None, None), ("ENTRY_FILLED_NEXT_OPEN", None, 10.0), ("STOP_TIGHTENED", lifecycle.BREAKEVEN_RULE, 10.0),
            ("H2_TOUCHED", None, 12.0), ("STOP_TIGHTENED", lifecycle.TRAIL_RULE, 11.0), ("TRAILING_STOP", None, 11.0)])] + [("u", 1, t(0), "SIGNAL_DETECTED", None, None)],
        "signal_id string, sequence int, event_time timestamp, event_type string, rule string, price double")
    signals = spark.createDataFrame([(i, t(0), 9.0, 9.5, 8.0, 11.0, 12.0, 13.0) for i in "su"] + [("v", t(0), None, 9.5, 8.0, 11.0, 12.0, 13.0)],
                                    "signal_id string, ts timestamp, zone_low double, zone_high double, stop double, t1 double, t2 double, t3 double")
    versions = lifecycle.plan_versions(signals, log)
    got = sorted((r["signal_id"], r["version"], r["from_sequence"], r["to_sequence"], r["reason"], r["stop"]) for r in versions.collect() if r["signal_id"] != "v")
    assert got == [("s", 1, 1, 3, "SIGNAL_PLAN", 8.0), ("s", 2, 3, 5, "BREAKEVEN_AFTER_H1", 10.0), ("s", 3, 5, None, "2_ATR_TRAIL", 11.0), ("u", 1, 1, None, "SIGNAL_PLAN", 8.0)]
    held = lifecycle.with_plan_in_force(log, versions).orderBy("signal_id", "sequence").collect()
    assert [(r["signal_id"], r["plan_version"]) for r in held] == [("s", 1), ("s", 1), ("s", 2), ("s", 2), ("s", 3), ("s", 3), ("u", 1)]
