"""Labels, audits, exits and accounts against plain loops and known figures."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import labels, portfolio, risk, trades
from test_series import START, bars_frame


#: name: (bars as (low, high), classification, highest target, bars to entry, bars after entry)
#: Zone 99 to 101, stop 98, targets 102, 103 and 104; entry within 8 bars, then 16 managed bars.
IN, OUT = (100.0, 101.0), (101.2, 101.8)
AUDITS = {
    "nothing yet": ([], "WAITING_ENTRY", 0, None, 0),
    "waiting": ([OUT] * 7, "WAITING_ENTRY", 0, None, 0),
    "never": ([OUT] * 8, "NO_ENTRY", 0, None, 0),
    "last chance": ([OUT] * 7 + [IN], "ENTRY_ACTIVE", 0, 8, 1),
    "too late": ([OUT] * 8 + [IN], "NO_ENTRY", 0, None, 0),
    "stop at once": ([(97.9, 105.0)], "STOPPED", 0, 1, 1),
    "target, then stop": ([IN, (100.0, 102.5), (97.0, 100.0)], "STOPPED", 1, 1, 3),
    "second": ([OUT, IN, (100.0, 103.0)], "H2_ACTIVE", 2, 2, 2),
    "third": ([IN, (100.0, 104.0), (97.0, 100.0)], "H3_REACHED", 3, 1, 3),
    "expired empty": ([IN] * 16, "EXPIRED_H0", 0, 1, 16),
    "expired with one": ([IN, (100.0, 102.0)] + [IN] * 14, "EXPIRED_H1", 1, 1, 16),
    "target after the end": ([IN] * 16 + [(100.0, 104.0)], "EXPIRED_H0", 0, 1, 16),
}


def test_level_audit(spark):
    signals, bars = [], []
    for name, (rows, *_) in AUDITS.items():
        signals.append(dict(signal_id=name, symbol=name, bar_no=0, ts=START, price=100.0, zone_low=99.0, zone_high=101.0, stop=98.0, t1=102.0, t2=103.0, t3=104.0))
        bars += [dict(symbol=name, bar_no=k, ts=START + dt.timedelta(minutes=15 * k), open=100.0, high=h, low=w, close=100.0, volume=1.0) for k, (w, h) in enumerate(rows, 1)]
    got = labels.level_audit(spark.createDataFrame(pd.DataFrame(signals)), spark.createDataFrame(pd.DataFrame(bars))).collect()
    assert {r["signal_id"]: (r["result_classification"], r["highest_target"], r["bars_to_entry"], r["bars_after_entry"]) for r in got} == {
        name: tuple(want) for name, (_, *want) in AUDITS.items()}


def test_bar_labels(spark):
    frame = bars_frame({s: 60 for s in "ABCDEFGH"}, seed=9, gap=False)
    frame["bar_no"] = frame.groupby("symbol").cumcount()
    rng = np.random.default_rng(1)
    picks = frame.sample(250, random_state=2)
    sig = pd.DataFrame({
        "signal_id": [f"s{k}" for k in range(len(picks))], "symbol": picks.symbol.values, "bar_no": picks.bar_no.values, "ts": picks.ts.values,
        "price": picks.close.values, "zone_low": picks.close.values - 0.6, "zone_high": picks.close.values + 0.1,
        "stop": picks.close.values - rng.uniform(0.8, 2, len(picks)), "t1": picks.close.values + 0.8, "t2": picks.close.values + 1.6, "t3": picks.close.values + 2.4})
    signals, bars = spark.createDataFrame(sig), spark.createDataFrame(frame)
    now = F.lit(str(START + dt.timedelta(days=30))).cast("timestamp")
    out = {(r["signal_id"], r["horizon"]): r for r in labels.label_bars(signals, bars, now).collect()}
    for s in sig.itertuples():
        rows = list(frame[(frame.symbol == s.symbol) & (frame.bar_no > s.bar_no)].itertuples())
        for name, n in labels.HORIZONS.items():
            o = out[(s.signal_id, name)]
            if len(rows) < n:
                assert o["status"] == "LABEL_PENDING" and o["forward_return"] is None
                continue
            part = rows[:n]
            assert np.isclose(o["forward_return"], part[-1].close / s.price - 1)
            assert np.isclose(o["maximum_favorable_excursion"], max(b.high for b in part) / s.price - 1)
            first = False
            for b in part:
                if b.low <= s.stop:
                    first = True
                    break
                if b.high >= s.price * 1.01:
                    break
            assert o["hit_stop_first"] == first


def test_known_label_figures(spark):
    """Bars from 100 upwards: the first horizon is due after one bar, the day label only after 18:00 local."""
    t0 = dt.datetime(2026, 1, 5, 10, 0)
    bars = spark.createDataFrame(pd.DataFrame([
        dict(symbol="A", bar_no=i + 1, ts=t0 + dt.timedelta(minutes=15 * (i + 1)), open=100.0, high=101.5 + 0.2 * i, low=99.5, close=100 + 0.1 * i, volume=1.0) for i in range(8)]))
    sig = spark.createDataFrame([("x", "A", 0, t0, 100.0, 98.0)], "signal_id string, symbol string, bar_no long, ts timestamp, price double, stop double")
    early = {r["horizon"]: r for r in labels.label_all(sig, bars, F.lit("2026-01-05 10:30:00").cast("timestamp")).collect()}
    assert early["15m"]["status"] == "LABEL_AVAILABLE" and early["30m"]["status"] == "LABEL_PENDING" and early["EOD"]["status"] == "LABEL_PENDING"
    late = labels.label_all(sig, bars, F.lit("2026-01-05 15:00:00").cast("timestamp"))
    by = {r["horizon"]: r for r in late.collect()}
    assert by["EOD"]["status"] == "LABEL_AVAILABLE" and by["NEXT_DAY"]["status"] == "LABEL_PENDING"
    assert by["15m"]["hit_plus_1_percent"] and not by["15m"]["hit_stop_first"]
    assert labels.lifecycle(late).first()["lifecycle"] == "PARTIALLY_LABELED"


def exit_loop(t, rows):
    for b in rows:
        for test, reason, fill in (
            (b.open <= t.stop, "STOP_GAP", b.open), (b.open >= t.target_2, "TARGET_2_GAP", b.open),
            (b.low <= t.stop and b.high >= t.target_1, "STOP_FIRST_AMBIGUITY", t.stop), (b.low <= t.stop, "STOP", t.stop),
            (b.high >= t.target_2, "TARGET_2", t.target_2), (b.high >= t.target_1, "TARGET_1", t.target_1)):
            if test:
                return b.ts, reason, fill
    return None


def test_exits_near_and_far(spark):
    frame = bars_frame({"A": 900, "B": 300}, seed=4, gap=False)
    frame["bar_no"] = frame.groupby("symbol").cumcount()
    rng = np.random.default_rng(6)
    picks = frame.sample(300, random_state=3)
    width = rng.choice([0.5, 2, 6, 30], len(picks))
    t = pd.DataFrame({"trade_id": [f"t{k}" for k in range(len(picks))], "symbol": picks.symbol.values, "entry_bar": picks.bar_no.values,
                      "stop": picks.close.values - width, "target_1": picks.close.values + width, "target_2": picks.close.values + 2 * width})
    got = {r["trade_id"]: r for r in trades.first_exits(spark.createDataFrame(t), spark.createDataFrame(frame), block=16).collect()}
    open_ = 0
    for row in t.itertuples():
        want = exit_loop(row, list(frame[(frame.symbol == row.symbol) & (frame.bar_no > row.entry_bar)].itertuples()))
        if want is None:
            assert row.trade_id not in got
            open_ += 1
            continue
        r = got[row.trade_id]
        assert (r["exit_time"], r["exit_reason"]) == (want[0].to_pydatetime(), want[1]) and np.isclose(r["raw_fill"], want[2])
    assert 0 < open_ < len(t)


def test_known_trade(spark):
    """Entry 10, stop 9, targets 11 and 12, equity 10,000: both levels inside one bar end at the stop."""
    day = [START + dt.timedelta(days=k) for k in range(3)]
    bars = spark.createDataFrame([("A", day[0], 0, 10.0, 10.5, 9.5, 10.0), ("A", day[1], 1, 10.0, 10.5, 9.5, 10.0), ("A", day[2], 2, 10.0, 12.5, 8.5, 12.0)],
                                 "symbol string, ts timestamp, bar_no long, open double, high double, low double, close double")
    orders = spark.createDataFrame([("i", "A", day[0], 0, 10.0, 9.0, 11.0, 12.0, 85, 100, "NEUTRAL")],
        "signal_id string, symbol string, signal_time timestamp, bar_no long, expected_entry double, stop double, target_1 double, target_2 double, score int, data_quality int, regime string")
    opened = trades.open_trades(trades.gate_entries(orders, bars, equity=10_000.0), equity=10_000.0)
    row = trades.close_trades(opened, trades.first_exits(opened, bars)).first()
    assert row["exit_reason"] == "STOP_FIRST_AMBIGUITY"
    assert np.isclose(row["entry_price"], 10.005) and np.isclose(row["exit_price"], 8.9955)
    assert np.isclose(row["net_pnl"], -77.1375375)


def test_marked_curve_figures(spark):
    """100 shares from 100, marked at 100, 80 and 110 without costs of slippage or commission."""
    day = [START + dt.timedelta(days=k) for k in range(3)]
    bars = spark.createDataFrame([("A", day[k], k, c) for k, c in enumerate((100.0, 80.0, 110.0))], "symbol string, ts timestamp, bar_no long, close double")
    t = spark.createDataFrame([("A", day[0], None, 100.0, 10.0, None)],
                              "symbol string, entry_time timestamp, exit_time timestamp, entry_price double, quantity double, net_pnl double")
    curve = portfolio.marked_curve(t, bars, 100_000.0, commission_bps=0.0, slippage_bps=0.0).orderBy("ts").collect()
    assert [round(r["mtm_equity"], 6) for r in curve] == [100_000, 99_800, 100_100]
    assert [r["open_positions"] for r in curve] == [1, 1, 1]


def test_trade_metrics_equal_numpy(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0.001, 0.02, 200)
    frame = pd.DataFrame({"n": range(200), "r": values, "days": 2.0})
    got = portfolio.trade_metrics(spark.createDataFrame(frame), ["n"], F.floor(F.col("n") / 16)).first()
    curve = np.concatenate(([1.0], np.cumprod(1 + values)))
    assert np.isclose(got["total_return"], curve[-1] - 1)
    assert np.isclose(got["max_drawdown"], (curve / np.maximum.accumulate(curve) - 1).min())
    assert np.isclose(got["sharpe_ratio"], values.mean() / values.std() * np.sqrt(252))
    assert np.isclose(got["sortino_ratio"], values.mean() / values[values < 0].std() * np.sqrt(252))
    assert np.isclose(got["profit_factor"], values[values > 0].sum() / abs(values[values <= 0].sum()))
    best = {True: 0, False: 0}
    run, last = 0, None
    for v in values > 0:
        run = run + 1 if v == last else 1
        last = v
        best[bool(v)] = max(best[bool(v)], run)
    assert (got["max_consecutive_wins"], got["max_consecutive_losses"]) == (best[True], best[False])


def test_risk_rules(spark):
    rows = spark.createDataFrame([(100.0, 2.0, 98.0), (100.0, 2.0, 95.0), (1.0, 2.0, 0.5), (100.0, 0.0, 95.0)], "close double, atr double, recent_low double")
    got = [tuple(r) for r in risk.add_trade_plan(rows).select("stop", "target_1", "target_2", "risk_reward").collect()]
    assert got == [(97.6, 103.6, 106.0, 2.5), (95.0, 107.5, 112.5, 2.5), (None, None, None, None), (None, None, None, None)]
    size = rows.select(risk.position_size(F.lit(100_000.0), F.lit(100.0), F.lit(98.0)).alias("q"), risk.position_size(F.lit(100_000.0), F.lit(100.0), F.lit(99.95)).alias("z")).first()
    assert size["q"] == 200 and size["z"] is None
