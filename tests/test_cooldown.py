"""Cooldown decisions against a plain loop."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import cooldown

BASE = dt.datetime(2024, 3, 4)


def loop(rows, seconds, points, inclusive, allowed=None):
    anchor, out = None, []
    for k, (ts, score) in enumerate(rows):
        recent = anchor is not None and (
            (ts - anchor[0]).total_seconds() <= seconds if inclusive else (ts - anchor[0]).total_seconds() < seconds)
        better = anchor is not None and score >= anchor[1] + points
        if recent and not better:
            out.append("COOLDOWN")
            continue
        if allowed is not None and not allowed[k]:
            out.append("BLOCKED")
            continue
        out.append("UPGRADED" if recent else "CREATED")
        anchor = (ts, score)
    return out


@pytest.mark.parametrize("minutes,seconds,inclusive", [(15, 3600, True), (15, 3600, False), (600, 100_000, True), (7, 90_000, False)])
def test_matches_loop(spark, minutes, seconds, inclusive):
    rng = np.random.default_rng(minutes)
    frames, want = [], {}
    for key in ("A", "B", "C"):
        steps = np.cumsum(rng.integers(1, 5, 300)) * minutes
        rows = [(BASE + dt.timedelta(minutes=int(m)), int(s)) for m, s in zip(steps, rng.integers(40, 100, 300))]
        ok = rng.random(300) < 0.7
        want.update({(key, ts): d for (ts, _), d in zip(rows, loop(rows, seconds, 5, inclusive, ok))})
        frames += [dict(symbol=key, ts=ts, score=s, ok=bool(o)) for (ts, s), o in zip(rows, ok)]
    frame = spark.createDataFrame(pd.DataFrame(frames))
    got = cooldown.decide(frame, ["symbol"], seconds, inclusive=inclusive, allowed="ok").collect()
    assert len(got) == 900
    wrong = [(r["symbol"], r["ts"], r["decision"], want[(r["symbol"], r["ts"])]) for r in got if want[(r["symbol"], r["ts"])] != r["decision"]]
    assert not wrong, (len(wrong), sorted(wrong)[:5])
    assert set(want.values()) == {"COOLDOWN", "BLOCKED", "CREATED", "UPGRADED"}


def test_repeated_rows_are_duplicates(spark):
    """Equal rows are decided once; of one instant the highest score is the signal."""
    rows = [("A", "15m", BASE, 70), ("A", "15m", BASE, 70), ("A", "15m", BASE, 60), ("A", "15m", BASE + dt.timedelta(minutes=15), 71)]
    got = cooldown.signal_decisions(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, score int")).collect()
    assert sorted((r["ts"], r["score"], r["decision"]) for r in got) == [
        (BASE, 60, "REJECTED_DUPLICATE"), (BASE, 70, "REJECTED_DUPLICATE"), (BASE, 70, "SIGNAL_CREATED"), (BASE + dt.timedelta(minutes=15), 71, "REJECTED_COOLDOWN")]


@pytest.mark.parametrize("block,seconds,inclusive", [(4, 3600, True), (8, 20_000, False), (2, 50_000, True)])
def test_many_blocks(spark, block, seconds, inclusive):
    """Walks over many small blocks: ends, levels and rounds of pointer doubling."""
    rng = np.random.default_rng(block)
    frames, want = [], {}
    for key, n in (("A", 700), ("B", 1), ("C", 90)):
        steps = np.cumsum(rng.integers(0, 30, n)) * 60
        rows = [(BASE + dt.timedelta(seconds=int(m)), int(s)) for m, s in zip(steps, rng.integers(40, 100, n))]
        ok = rng.random(n) < 0.7
        want.update({(key, k): d for k, d in enumerate(loop(rows, seconds, 5, inclusive, ok))})
        frames += [dict(symbol=key, ts=ts, score=s, ok=bool(o), seq=k) for k, ((ts, s), o) in enumerate(zip(rows, ok))]
    frame = spark.createDataFrame(pd.DataFrame(frames))
    got = cooldown.decide(frame, ["symbol"], seconds, inclusive=inclusive, allowed="ok", order="seq", block=block).collect()
    assert {(r["symbol"], r["seq"]): r["decision"] for r in got} == want


def test_missing_scores(spark):
    """A missing score is no upgrade, and is upgraded by none; it may be accepted once the cooldown is over."""
    at = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [("A", at(0), 50), ("A", at(10), None), ("A", at(100), None), ("A", at(110), 99), ("A", at(200), 10)]
    got = cooldown.decide(spark.createDataFrame(rows, "symbol string, ts timestamp, score int"), ["symbol"], 3600).collect()
    assert [r["decision"] for r in sorted(got, key=lambda r: r["ts"])] == ["CREATED", "COOLDOWN", "CREATED", "COOLDOWN", "CREATED"]
