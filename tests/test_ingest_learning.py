"""Ingestion, sources, quality and learning on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import ingest, learning, quality, scoring
from barloom.sources import sinks, vendor

T0 = dt.datetime(2026, 1, 5, 8, 0)


def test_both_vendors_give_the_same_bar(spark):
    symbols = spark.createDataFrame([("X:ABC", "ABC"), ("ABC.IS", "ABC")], "vendor_symbol string, symbol string")
    a = spark.createDataFrame([('{"ticker":"X:ABC","time":"2026-01-05T08:00:00Z","interval":"15m","o":"10","h":"11","l":"9","c":"10.5","v":"100"}',),
                               ('{"ticker":"X:ABC","time":"2026-01-05T08:00:00","interval":"15m","o":"10","h":"11","l":"9","c":"nan","v":"100"}',)], "payload string")
    b = spark.createDataFrame([('{"instrument":"ABC.IS","ts":1767600000,"tf":"15m","openPrice":10,"highPrice":11,"lowPrice":9,"lastPrice":10.5,"totalVolume":100}',)], "payload string")
    columns = ["symbol", "ts", "timeframe", "open", "high", "low", "close", "volume"]
    first, broken = vendor.normalise_a(a, symbols).select(columns).orderBy(F.col("ts").asc_nulls_last()).collect()
    assert first == vendor.normalise_b(b, symbols).select(columns).first()
    assert broken["ts"] is None and broken["close"] is None  # no zone, not a number


def test_registry_walk(spark):
    html = ("<table><tr><td>YILDIZ PAZAR 2 Şirket / Fon Bulundu</td></tr><tr><td>1</td><td>newco</td><td>New Co</td></tr>"
            "<tr><td>2</td><td>BOTH</td><td>Both</td></tr><tr><td>x</td><td>SKIP</td><td>Skip</td></tr>"
            "<tr><td>YAPILANDIRILMIŞ ÜRÜNLER VE FON PAZARI</td></tr><tr><td>1</td><td>ETFXX</td><td>Fund</td></tr><tr><td>2</td><td>BOTH</td><td>Twice</td></tr></table>")
    got = vendor.registry_instruments(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("symbol").collect()
    assert [(r["symbol"], r["instrument_type"], r["accepted"]) for r in got] == [
        ("BOTH", "EQUITY", True), ("ETFXX", "STRUCTURED_OR_FUND", False), ("NEWCO", "EQUITY", True)]


def raw(spark, rows):
    return spark.createDataFrame(
        [("p", "A", "1d", T0 + dt.timedelta(days=d), 10.0, 11.0, 9.0, c, v, seq, T0 + dt.timedelta(days=d + 1), True) for d, c, v, seq in rows],
        "provider string, symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, ingest_seq long, received_at timestamp, is_adjusted boolean")


def test_classify_counts(spark):
    incoming = raw(spark, [(0, 10.0, 1.0, 0), (0, 10.0, 1.0, 1), (0, 10.5, 1.0, 2), (1, 10.0, 1.0, 3), (2, 10.0, -1.0, 4)])
    got = ingest.ingest_metrics(incoming).first()
    assert (got["bars_received"], got["invalid_bars"], got["new_bars"], got["duplicate_bars"], got["revised_bars"]) == (5, 1, 2, 1, 1)
    again = ingest.ingest_metrics(incoming, existing=raw(spark, [(0, 10.0, 1.0, 0)])).first()
    assert (again["new_bars"], again["duplicate_bars"], again["revised_bars"]) == (1, 2, 1)
    dry = ingest.ingest_metrics(incoming, existing=raw(spark, [(0, 10.0, 1.0, 0)]), dry_run=True).first()
    assert (dry["new_bars"], dry["duplicate_bars"], dry["revised_bars"]) == (1, 2, 1)


def test_hash_ignores_order_and_sees_values(spark):
    a = raw(spark, [(d, 10.0 + d, 1.0, d) for d in range(30)])
    b = a.orderBy(F.desc("ts")).repartition(3)
    c = raw(spark, [(d, 10.0 + d + (d == 7) * 0.001, 1.0, d) for d in range(30)])
    one, two, three = (ingest.dataset_hash(x, 86400).first()[0] for x in (a, b, c))
    assert one == two != three


def test_import_is_idempotent(spark, tmp_path):
    bars = raw(spark, [(d, 10.0 + d, 1.0, d) for d in range(10)])
    first = sinks.import_bars(spark, bars, str(tmp_path), 86400)
    assert (first["inserted"], first["duplicates"]) == (10, 0)
    assert sinks.import_bars(spark, bars, str(tmp_path), 86400)["duplicates"] == 10
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 10


def test_series_states(spark):
    now = F.lit(str(T0 + dt.timedelta(days=4))).cast("timestamp")
    ok = [(d, 10.0, 1.0, d) for d in range(3)]
    state = lambda rows: quality.validate_series(raw(spark, rows).withColumn("symbol", F.lit("ABC")), now).first()
    assert state(ok)["status"] == "OK" and state(ok)["quality_score"] == 100
    assert state(ok[:1])["status"] == "STALE"
    bad = state([(0, 10.0, 1.0, 0), (0, 10.0, 1.0, 1), (2, 10.0, -1.0, 2)])
    assert bad["errors"] == ["duplicate bar", "negative volume"] and bad["quality_score"] == 60
    late = state([(1, 10.0, 1.0, 0), (0, 10.0, 1.0, 1), (3, 10.0, 1.0, 2)])
    assert late["errors"] == ["bars out of order"]


def test_text_rules(spark):
    rows = spark.createDataFrame([("Yeni yatırım ve ihale",), ("sakin gün",)], "t string")
    assert [r[0] for r in rows.select(scoring.classify_text(F.col("t"))).collect()] == ["tender", "other"]


def test_heads_minimise_the_penalised_loss(spark):
    """At the fitted weights the gradient of loss and penalty vanishes; the area counts ordered pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * (x[:, 1] - 10))))).astype(int)
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "i": range(600)}))
    names = ("a", "b", "c")
    got = learning.predict(learning.fit_head(frame, names), frame, "p", names).orderBy("i").toPandas()
    p = got.p.to_numpy()
    scaled = np.column_stack([np.ones(600), (x - x.mean(0)) / x.std(0, ddof=1)])
    weights, residual, *_ = np.linalg.lstsq(scaled, np.log(p / (1 - p)), rcond=None)
    assert residual.sum() < 1e-12  # the log odds are linear in the features
    gradient = scaled.T @ (p - y) / 600 + learning.L2 * np.r_[0, weights[1:]]
    assert np.abs(gradient).max() < 1e-4
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    m = learning.classification_metrics(got_frame(spark, got)).first()
    assert abs(m["roc_auc"] - np.mean(pairs)) < 1e-9
    assert 0 < m["pr_auc"] < 1


def got_frame(spark, pdf):
    return spark.createDataFrame(pdf[["label", "p"]])


def test_split_and_embargo(spark):
    frame = spark.createDataFrame([(f"s{k:03d}", T0 + dt.timedelta(hours=k), 1) for k in range(100)], "signal_id string, ts timestamp, label int")
    parts = [r["part"] for r in learning.chronological_split(frame).orderBy("ts").collect()]
    assert parts[:44] == ["train"] * 44 and parts[44:60] == ["embargo"] * 16 and parts[60:64] == ["validation"] * 4 and parts[80:] == ["test"] * 20


def test_calibration_edges(spark):
    frame = spark.createDataFrame([(p, 1) for p in (0.0, 0.3, 0.6, 0.95, 1.0)], "p double, label int")
    got = sorted(round(r["lower"], 1) for r in learning.calibration(frame).collect())
    assert got == [0.0, 0.2, 0.9]


def head_queries(spark, monkeypatch, rows):
    from barloom.plans import learning as plans

    monkeypatch.setattr(plans, "training_rows", lambda spark, folder: rows)
    return [plans.QUERIES[name](spark, "none") for name in ("m05_heads_are_fitted", "m05_logistic_heads")]


def test_no_head_can_be_fitted(spark, monkeypatch):
    """Signals that all miss their entry, or no signals: tables without rows instead of an error."""
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("signal_id"), F.timestamp_seconds(F.col("id") * 900).alias("ts"),
        *[(F.col("id") % 7).cast("double").alias(n) for n in learning.FEATURES], (F.col("id") % 2).cast("int").alias("entry"),
        *[F.lit(0).alias(h) for h in learning.HEADS[1:]])
    full = [out.dtypes for out in head_queries(spark, monkeypatch, rows)]
    for part in (rows.withColumn("entry", F.lit(0)), rows.filter("signal_id IS NULL")):
        none = head_queries(spark, monkeypatch, part)
        assert [out.count() for out in none] == [0, 0]
        assert [out.dtypes for out in none] == full
