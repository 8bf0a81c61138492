"""Skew-safe layout: numbering, blocks, scans and quantiles against pandas on small block sizes."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.recursive import add_means, span_mean, wilder_mean
from barloom.operators.features import daily_features
from barloom.operators.joins import as_of
from barloom.quantiles import exact_quantiles
from barloom.series import blocked, number_bars, running

START = dt.datetime(2024, 1, 1)


def bars_frame(rows_per_symbol, seed=0, gap=True):
    rng = np.random.default_rng(seed)
    out = []
    for symbol, n in rows_per_symbol.items():
        at = np.cumsum(rng.integers(1, 4, n) if gap else np.ones(n, int))
        close = 100 + np.cumsum(rng.normal(0, 1, n)) * 0.5
        spread = np.abs(rng.normal(0, 0.6, (2, n)))
        opens = close + rng.normal(0, 0.3, n)
        out.append(pd.DataFrame({
            "symbol": symbol, "ts": [START + dt.timedelta(minutes=15 * int(k)) for k in at], "open": opens,
            "high": np.maximum(opens, close) + spread[0], "low": np.minimum(opens, close) - spread[1], "close": close,
            "volume": rng.integers(0, 50, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


def test_numbers_are_dense_across_slices(spark):
    frame = bars_frame({"A": 2500, "B": 7, "C": 1})
    got = number_bars(spark.createDataFrame(frame).orderBy(F.rand(1)), 900).toPandas()
    for _, g in got.groupby("symbol"):
        assert list(g.sort_values("ts")["bar_no"]) == list(range(len(g)))


@pytest.mark.parametrize("size", [64, 1024])
def test_recursions_and_windows_equal_pandas(spark, size):
    frame = bars_frame({"A": 700, "B": 130, "C": 12})
    s = blocked(number_bars(spark.createDataFrame(frame), 900), halo=32, size=size)
    s = s.add({"tr": ind.true_range(s), "d": ind.diff(s, F.col("close"))})
    s = s.add({"up": F.greatest("d", F.lit(0.0)), "down": -F.least("d", F.lit(0.0)), "ret": ind.pct_change(s, F.col("close"))})
    s = add_means(s, [span_mean(f"ema{p}", "close", p) for p in (12, 26, 200)] + [
        wilder_mean("gain", "up", 14, 1), wilder_mean("loss", "down", 14, 1), wilder_mean("atr", "tr", 14)], ["volume"], ("ema12", "ema26", 9))
    s = s.add({"rsi": ind.rsi_from_means(F.col("gain"), F.col("loss")), "slope": ind.diff(s, F.col("ema12"), 5),
               "sma": ind.sma(s, F.col("close"), 20), "vol": ind.rolling_volatility(s, F.col("ret")), "rvol": ind.relative_volume(s, F.col("volume"))})
    got = s.rows().toPandas()
    assert len(got) == len(frame)
    for _, g in got.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        c, prev = g.close, g.close.shift(1)
        ema = {p: c.ewm(span=p, adjust=False, min_periods=p).mean() for p in (12, 26, 200)}
        line = ema[12] - ema[26]
        tr = pd.concat([g.high - g.low, (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)
        gain = c.diff().clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        loss = (-c.diff().clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        mean = g.volume.shift(1).rolling(20).mean()
        want = {
            **{f"ema{p}": v for p, v in ema.items()}, "macd": line, "macd_signal": line.ewm(span=9, adjust=False, min_periods=9).mean(),
            "atr": tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), "rsi": 100 - 100 / (1 + gain / loss), "slope": ema[12].diff(5),
            "sma": c.rolling(20).mean(), "vol": c.pct_change().rolling(20).std(ddof=0), "rvol": g.volume / mean.replace(0, np.nan),
            "cum_volume": g.volume.cumsum(),
        }
        for name, ref in want.items():
            mine = g[name].astype(float)
            assert (mine.isna() == ref.isna()).all(), name
            assert (mine - ref).abs().max() < 1e-8 or ref.isna().all(), name


def test_later_bars_do_not_change_features(spark):
    frame = bars_frame({"A": 400, "B": 260})
    whole = daily_features(blocked(number_bars(spark.createDataFrame(frame), 900), size=128)).rows()
    cut = frame[frame.ts < frame.ts.sort_values().iloc[len(frame) // 2]]
    part = daily_features(blocked(number_bars(spark.createDataFrame(cut), 900), size=128)).rows()
    names = ["symbol", "ts", "rsi", "atr", "macd_histogram", "breakout", "rvol", "ema20_slope"]
    a = whole.select(names).toPandas().merge(part.select(names).toPandas(), on=["symbol", "ts"], suffixes=("", "_x"))
    assert len(a) == len(cut)
    for name in names[2:]:
        assert np.allclose(a[name].astype(float), a[f"{name}_x"].astype(float), equal_nan=True), name


def test_running_folds(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": rng.choice(["x", "y"], 500), "n": np.arange(500), "v": rng.normal(0, 1, 500), "g": 1 + rng.normal(0, 0.01, 500)})
    frame["u"] = frame.v.where(rng.random(500) < 0.3)
    out = running(spark.createDataFrame(frame).withColumn("u", F.when(~F.isnan("u"), F.col("u"))), ["k"], ["n"], F.floor(F.col("n") / 40),
                  {"s": ("v", "sum"), "hi": ("v", "max"), "lo": ("v", "min"), "p": ("g", "product"), "last": ("u", "last")}).toPandas()
    for _, g in out.groupby("k"):
        g = g.sort_values("n")
        assert np.allclose(g.s, g.v.cumsum()) and np.allclose(g.hi, g.v.cummax()) and np.allclose(g.lo, g.v.cummin())
        assert np.allclose(g.p, g.g.cumprod())
        assert np.allclose(g["last"].astype(float), g.u.astype(float).ffill(), equal_nan=True)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": rng.choice(list("abc"), 3000), "v": np.round(rng.normal(0, 3, 3000), 2)})
    frame.loc[:900, "v"] = 1.25  # a third of all rows share one value
    got = exact_quantiles(spark.createDataFrame(frame), ["k"], "v", {
        "m": (0.5, "linear"), "p95": (0.95, "linear"), "up": (0.5, "upper"), "near": (0.99, "nearest")}).toPandas().set_index("k")
    for k, g in frame.groupby("k"):
        v = np.sort(g.v.to_numpy())
        assert np.isclose(got.loc[k, "m"], np.median(v)) and np.isclose(got.loc[k, "p95"], np.percentile(v, 95))
        assert np.isclose(got.loc[k, "up"], v[len(v) // 2]) and np.isclose(got.loc[k, "near"], v[round((len(v) - 1) * 0.99)])


def test_as_of(spark):
    left = pd.DataFrame({"symbol": "A", "ts": [START + dt.timedelta(hours=h) for h in (0, 5, 30, 31, 80)], "id": range(5)})
    right = pd.DataFrame({"symbol": "A", "ts": [START + dt.timedelta(hours=h) for h in (5, 29)], "close": [1.0, 2.0]})
    got = as_of(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], F.floor(F.unix_seconds("ts") / 86400), ["close"], tie="id")
    assert [r["close"] for r in got.orderBy("id").collect()] == [None, 1.0, 2.0, 2.0, 2.0]


@pytest.mark.parametrize("largest", [1, 50, 4096])
def test_quantiles_of_concentrated_values(spark, largest):
    """Values that share exponent and leading bits are told apart by refining, for several groups at once."""
    rng = np.random.default_rng(largest)
    frames = {
        "narrow": 100 + rng.random(3000) * 0.2, "nearer": 1 + rng.integers(0, 500, 2000) * 2.0**-50, "equal": np.full(700, 5.5),
        "wide": np.concatenate([rng.standard_normal(500) * 10.0 ** rng.integers(-200, 200, 500), [0.0, -0.0]]), "one": np.array([3.25]),
    }
    frame = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in frames.items()])
    got = exact_quantiles(spark.createDataFrame(frame), ["k"], "v", {
        "q10": (0.1, "linear"), "median": (0.5, "linear"), "upper": (0.5, "upper"), "p95": (0.95, "nearest")}, largest=largest).collect()
    assert len(got) == len(frames)
    for r in got:
        v = np.sort(frames[r["k"]])
        n = len(v)
        for name, p in (("q10", 0.1), ("median", 0.5)):
            at = (n - 1) * p
            low = int(at)
            want = v[low] * (1 - (at - low)) + v[min(low + 1, n - 1)] * (at - low)
            assert r[name] == pytest.approx(want, rel=1e-12, abs=0)
        assert r["upper"] == v[n // 2] and r["p95"] == v[min(n - 1, round((n - 1) * 0.95))]
