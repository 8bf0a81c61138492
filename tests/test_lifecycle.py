"""Lifecycle windows: setups written down by hand, and what holds for random ones."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import lifecycle

START = dt.datetime(2024, 1, 2, 8, 0)


SIGNAL = dict(bar_no=0, ts=START, rvol=1.0, zone_low=99.5, zone_high=100.5, stop=98.8, t1=104.2, t2=105.5, t3=107.0)


def bar(open_, high, low, close, momentum=0.0, rvol=1.0, vwap=90.0, ema=90.0, atr=0.5):
    return dict(open=open_, high=high, low=low, close=close, volume=1000.0, ctx_momentum=momentum, ctx_rvol=rvol, ctx_vwap=vwap, ctx_ema20=ema, ctx_atr=atr)


TOUCH = bar(100.6, 101, 100, 100.4)  # comes back into the zone: entry at the next open
ABOVE = bar(101, 101.2, 100.8, 101)  # waits above the zone, not far enough to be chased
FLAT = bar(100.2, 100.6, 99.9, 100.2)
BEGIN, FILL = ["SIGNAL_DETECTED", "STATE_REVIEW"], ["ENTRY_CONDITIONS_READY", "ENTRY_FILLED_NEXT_OPEN"]

#: name: (signal changes, bars, events, outcome, realised R, highest target)
SCENARIOS = {
    "no bar yet": ({}, [], ["SIGNAL_DETECTED"], None, None, 0),
    "structure": ({}, [bar(100, 100.2, 98.9, 99, -0.02, 1, 100, 100)], [*BEGIN, "SETUP_INVALIDATED"], "NO_ENTRY_STRUCTURE", None, 0),
    "decay": ({}, [ABOVE, ABOVE, {**ABOVE, "ctx_rvol": 0.3, "ctx_momentum": -0.001}], [*BEGIN, "SETUP_REVIEWED", "SETUP_INVALIDATED"], "NO_ENTRY_DECAY", None, 0),
    "expired": ({}, [ABOVE] * 9, [*BEGIN, "SETUP_REVIEWED", "ENTRY_TTL_EXPIRED"], "NO_ENTRY_EXPIRED", None, 0),
    "chased": ({}, [bar(101, 102.2, 101, 102)], [*BEGIN, "SETUP_CHASED"], "CHASED", None, 0),
    "chased at the open": ({}, [TOUCH, bar(103, 103.2, 102.8, 103)], [*BEGIN, "ENTRY_CONDITIONS_READY", "ENTRY_REJECTED_CHASE"], "CHASED", None, 0),
    "poor reward": (dict(t1=102.5), [TOUCH, FLAT], [*BEGIN, "ENTRY_CONDITIONS_READY", "ENTRY_REJECTED_RR"], "NO_ENTRY_STRUCTURE", None, 0),
    "stopped": ({}, [TOUCH, bar(100.2, 100.4, 98.7, 99)], [*BEGIN, *FILL, "HARD_STOP"], "STOP_BEFORE_H1", -1.0, 0),
    "stop wins inside a bar": ({}, [TOUCH, bar(100.2, 107.5, 98.7, 99)], [*BEGIN, *FILL, "HARD_STOP"], "STOP_BEFORE_H1", -1.0, 0),
    "all targets": ({}, [TOUCH, bar(100.2, 107.5, 99.5, 107)],
                    [*BEGIN, *FILL, "H1_TOUCHED", "STOP_TIGHTENED", "H2_TOUCHED", "H3_TOUCHED"], "H3_EXIT", (107 - 100.2) / 1.4, 3),
    # 104 less two ranges of 0.5: the stop stands at 103
    "trailing": ({}, [TOUCH, bar(100.2, 104.5, 99.9, 104), bar(104, 104.1, 102.9, 103)],
                 [*BEGIN, *FILL, "H1_TOUCHED", "STOP_TIGHTENED", "STOP_TIGHTENED", "TRAILING_STOP"], "TRAILING_EXIT", (103 - 100.2) / 1.4, 1),
    "thesis": ({}, [TOUCH, FLAT, FLAT, FLAT, {**FLAT, "ctx_momentum": -0.02, "ctx_vwap": 101.0}, bar(99.5, 99.8, 99.3, 99.5)],
               [*BEGIN, *FILL, *["POSITION_ACTIVE"] * 3, "EXIT_FILLED_NEXT_OPEN"], "THESIS_INVALIDATED", (99.5 - 100.2) / 1.4, 0),
    "time": ({}, [TOUCH, *[FLAT] * 16, bar(100.25, 100.3, 100.2, 100.2)], None, "TIME_EXIT_FLAT", 0.05 / 1.4, 0),
}


def test_scenarios(spark):
    """Setups written down by hand with what the rules make of them."""
    signals, bars = [], []
    for name, (change, rows, *_) in SCENARIOS.items():
        signals.append(dict(SIGNAL, **change, signal_id=name, symbol=name))
        bars += [dict(b, symbol=name, bar_no=k, ts=START + dt.timedelta(minutes=15 * k)) for k, b in enumerate(rows, 1)]
    table, log = lifecycle.evaluate(spark.createDataFrame(pd.DataFrame(signals)), spark.createDataFrame(pd.DataFrame(bars)), F.lit("2024-02-01").cast("timestamp"))
    got = {r["signal_id"]: r for r in table.collect()}
    events = {}
    for r in log.orderBy("signal_id", "sequence").collect():
        events.setdefault(r["signal_id"], []).append(r["event_type"])
    assert set(got) == set(SCENARIOS)
    for name, (_, _, want, outcome, realized, highest) in SCENARIOS.items():
        row = got[name]
        assert want is None or events[name] == want, (name, events[name])
        assert (row["outcome"], row["highest_target"], row["symbol"]) == (outcome, highest, name), (name, row)
        assert (row["realized_r"] is None) == (realized is None) and (realized is None or abs(row["realized_r"] - realized) < 1e-9), (name, row)
    assert "TRADE_STALLED" in events["time"] and events["time"][-1] == "EXIT_FILLED_NEXT_OPEN"


def test_open_bars_are_left_out(spark):
    """A signal counts once its own bar is complete."""
    signals = spark.createDataFrame(pd.DataFrame([dict(SIGNAL, signal_id="a", symbol="A")]))
    bars = spark.createDataFrame(pd.DataFrame([dict(TOUCH, symbol="A", bar_no=1, ts=START + dt.timedelta(minutes=15))]))
    for minutes, n in ((14, 0), (15, 1)):
        table, log = lifecycle.evaluate(signals, bars, F.lit(str(START + dt.timedelta(minutes=minutes))).cast("timestamp"))
        assert (table.count(), log.count()) == (n, n)


def random_case(rng, number):
    length = int(rng.integers(0, 30))
    drift = rng.choice([0.0, 0.12, -0.1, 0.3])
    price, bars = 100 + rng.normal(0, 0.6), []
    for k in range(length):
        o = price + rng.normal(0, 0.15)
        c = o + rng.normal(drift, 0.6)
        bars.append(dict(
            symbol=f"S{number}", bar_no=k + 1, ts=START + dt.timedelta(minutes=15 * (k + 1)), open=o,
            high=max(o, c) + abs(rng.normal(0, 0.3)), low=min(o, c) - abs(rng.normal(0, 0.3)), close=c, volume=1000.0,
            ctx_momentum=float(rng.normal(0.0, 0.012)), ctx_rvol=float(rng.uniform(0.3, 2.5)),
            ctx_vwap=c + float(rng.normal(0, 0.5)), ctx_ema20=c + float(rng.normal(-0.4, 0.8)), ctx_atr=float(rng.uniform(0.2, 0.9))))
        price = c
    sig = dict(signal_id=f"id{number}", symbol=f"S{number}", bar_no=0, ts=START, rvol=float(rng.uniform(0.5, 2)),
               zone_low=99.5, zone_high=100.5, stop=98.8, t1=104.2, t2=105.5, t3=107.0)
    return sig, bars


def test_invariants(spark):
    """What holds for every setup, over random bars."""
    rng = np.random.default_rng(7)
    cases = [random_case(rng, k) for k in range(400)]
    signals = spark.createDataFrame(pd.DataFrame([s for s, _ in cases]))
    bars = spark.createDataFrame(pd.DataFrame([b for _, rows in cases for b in rows]))
    table, log = lifecycle.evaluate(signals, bars, F.lit("2024-02-01").cast("timestamp"))
    events = {}
    for r in log.orderBy("signal_id", "sequence").collect():
        events.setdefault(r["signal_id"], []).append(r)
    by = {s["signal_id"]: (s, rows) for s, rows in cases}
    outcomes = set()
    for r in table.collect():
        sig, rows = by[r["signal_id"]]
        mine = events[r["signal_id"]]
        assert [e["sequence"] for e in mine] == list(range(1, len(mine) + 1)) and mine[0]["event_type"] == "SIGNAL_DETECTED"
        assert all(a["state_to"] == b["state_from"] and a["event_time"] <= b["event_time"] for a, b in zip(mine, mine[1:]))
        assert r["state"] == mine[-1]["state_to"] and r["symbol"] == sig["symbol"]
        filled = [e for e in mine if e["event_type"] == "ENTRY_FILLED_NEXT_OPEN"]
        assert (r["entry_price"] is not None) == bool(filled) and len(filled) <= 1
        touched = [e["event_type"] for e in mine if e["event_type"].endswith("_TOUCHED")]
        assert touched == [f"H{k}_TOUCHED" for k in range(1, r["highest_target"] + 1)]
        if filled:
            opens = {b["ts"]: b["open"] for b in rows}
            assert r["entry_price"] == opens[filled[0]["event_time"]] and r["active_stop"] >= sig["stop"]
            risk = r["entry_price"] - sig["stop"]
            assert risk > 0 and (sig["t1"] - r["entry_price"]) / risk >= 2 and r["mfe_r"] >= 0 >= r["mae_r"]
            if r["exit_price"] is not None:
                assert abs(r["realized_r"] - (r["exit_price"] - r["entry_price"]) / risk) < 1e-9 and r["outcome"]
        else:
            assert r["exit_price"] is None and r["realized_r"] is None
        outcomes.add(r["outcome"])
    assert len(outcomes) >= 8, outcomes


def test_prefix_of_events_is_stable(spark):
    rng = np.random.default_rng(11)
    cases = [random_case(rng, k) for k in range(60)]
    signals = spark.createDataFrame(pd.DataFrame([s for s, _ in cases]))
    bars = spark.createDataFrame(pd.DataFrame([b for _, rows in cases for b in rows]))
    _, late = lifecycle.evaluate(signals, bars, F.lit("2024-02-01").cast("timestamp"))
    _, early = lifecycle.evaluate(signals, bars, F.lit("2024-01-02 10:30:00").cast("timestamp"))
    whole = {(r["signal_id"], r["sequence"]): tuple(r) for r in late.collect()}
    for r in early.collect():
        assert whole[(r["signal_id"], r["sequence"])] == tuple(r)
    assert lifecycle.new_events(late, early).count() == len(whole) - early.count()
