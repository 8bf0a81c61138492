"""Outcome heads: features, chronological split, logistic models, baselines and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.analytics import TERMINAL_RESULTS, TRAINING_THRESHOLD
from barloom.quantiles import exact_quantiles
from barloom.series import running
from barloom.staging import hold

# Model inputs in order, heads, embargo and fit parameters.
FEATURES = (
    "radar_score", "rsi", "macd", "macd_histogram", "rvol", "atr", "vwap_distance", "ema9_distance", "ema20_distance",
    "ema50_distance", "breakout_distance", "relative_strength", "volume_acceleration", "price_acceleration", "data_quality",
    "early_momentum_score",
)
HEADS = ("entry", "stop", "h1", "h2", "h3")
EMBARGO = 16
L2 = 0.01
CLIP = 1e-12


def feature_columns(names: Sequence[str] = FEATURES) -> list[Column]:
    """Numeric features; missing or unreadable ones are 0."""
    return [F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)).alias(n) for n in names]


def training_rows(signals: DataFrame, audits: DataFrame) -> DataFrame:
    """Signals with a terminal audit, their features and the five labels."""
    ends = audits.filter((F.col("audit_version") == 2) & F.col("result_classification").isin(*TERMINAL_RESULTS))
    rows = signals.select("signal_id", "ts", *feature_columns()).join(ends, "signal_id")
    top = F.col("highest_target")
    return rows.select(
        "signal_id", "ts", *FEATURES,
        F.col("entry_hit_at").isNotNull().cast("int").alias("entry"), (F.col("result_classification") == "STOPPED").cast("int").alias("stop"),
        (top >= 1).cast("int").alias("h1"), (top >= 2).cast("int").alias("h2"), (top >= 3).cast("int").alias("h3"),
    )


def head_rows(rows: DataFrame, head: str) -> DataFrame:
    """The population a head is conditioned on, its label as ``label``."""
    given = {"entry": F.lit(True), "stop": F.col("entry") == 1, "h1": F.col("entry") == 1, "h2": F.col("h1") == 1, "h3": F.col("h2") == 1}
    return rows.filter(given[head]).withColumn("label", F.col(head))


def chronological_split(
    rows: DataFrame, order: Sequence[str] = ("ts", "signal_id"), embargo: int = EMBARGO, keys: Sequence[str] = (),
) -> DataFrame:
    """Adds ``part``: train, validation, test, or embargo for the rows dropped between them, per ``keys`` (few values).

    Positions come from a two-level count, so no task orders the whole table.
    """
    base = rows.withColumn("_one", F.lit(1))
    slices = F.floor(F.unix_micros(order[0]) / 900_000_000)
    numbered = running(base, list(keys), list(order), slices, {"_pos": ("_one", "sum")}).withColumn("_pos", F.col("_pos") - 1)
    n = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    rows = numbered.join(n, list(keys)) if keys else numbered.crossJoin(n)  # one row for each key
    train = F.floor(F.col("_n") * 0.6)
    until = F.floor(F.col("_n") * 0.8)
    gap = F.least(F.lit(embargo), F.greatest(F.lit(0), F.least(train, until - train) - 1))
    part = (
        F.when(F.col("_pos") < train - gap, "train").when(F.col("_pos") < train, "embargo")
        .when(F.col("_pos") < until - gap, "validation").when(F.col("_pos") < until, "embargo").otherwise("test")
    )
    return rows.withColumn("part", part).drop("_one", "_pos", "_n")


@dataclass(frozen=True)
class Head:
    """A logistic model: intercept and one weight for each feature as it stands in the table."""

    names: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def probability(self) -> Column:
        log_odds = F.lit(self.intercept)
        for name, weight in zip(self.names, self.weights):
            log_odds = log_odds + F.lit(weight) * F.col(name)
        return 1 / (1 + F.exp(-log_odds))


def predict(model: Head, rows: DataFrame, name: str = "probability", names: Sequence[str] = FEATURES) -> DataFrame:
    return rows.withColumn(name, model.probability())


def split_heads(rows: DataFrame) -> DataFrame:
    """All heads' populations, each split in the order of time: a row for each head that a signal belongs to."""
    given = {"entry": F.lit(True), "stop": F.col("entry") == 1, "h1": F.col("entry") == 1, "h2": F.col("h1") == 1, "h3": F.col("h2") == 1}
    members = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(head).alias("head"), F.col(head).alias("label"))) for head, test in given.items()]))
    long = rows.withColumn("_m", F.explode(members)).select("*", "_m.head", "_m.label").drop("_m", *HEADS)
    return hold(chronological_split(long, keys=("head",)))


def _statistics(train: DataFrame, names: Sequence[str], weights: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] | None) -> dict[str, np.ndarray]:
    """One scan: for each head a matrix of sums over its rows.

    Without weights it is Z'Z of the rows Z = (1, features, label).  With them (mean, deviation,
    weights of a head) it is the curvature of the loss, its gradient and, in the corner, the loss itself.
    A task sends one line for each row of a head's matrix, so the driver gets one matrix a head.
    """
    names = list(names)

    def sums(x: np.ndarray, y: np.ndarray, head: str) -> np.ndarray:
        ones = np.ones(len(y))
        if weights is None:
            z = np.column_stack([ones, x, y])
            return z.T @ z
        mean, deviation, w = weights[head]
        z = np.column_stack([ones, (x - mean) / deviation])
        odds = z @ w
        p = 1 / (1 + np.exp(-odds))
        curve = (z * (p * (1 - p))[:, None]).T @ z
        loss = float(np.logaddexp(0, odds).sum() - (odds * y).sum())
        return np.block([[curve, (z.T @ (p - y))[:, None]], [np.zeros((1, z.shape[1])), np.array([[loss]])]])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.array(batch.column("head").to_pylist(), object)
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            for head in sorted(set(heads.tolist())):
                if weights is None or head in weights:
                    own = heads == head
                    part = sums(x[own], y[own], head)
                    total[head] = total[head] + part if head in total else part
        for head, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([head] * len(m)), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["head", "line", "entries"])

    lines = train.select("head", F.col("label").cast("int").alias("label"), *names).mapInArrow(run, "head string, line int, entries array<double>")
    cells = lines.select("head", "line", F.posexplode("entries").alias("at", "entry")).groupBy("head", "line", "at").agg(F.sum("entry").alias("entry"))
    out: dict[str, np.ndarray] = {}
    size = len(names) + 2
    for r in cells.collect():  # a matrix of the features' number for each head
        out.setdefault(r["head"], np.zeros((size, size)))[r["line"], r["at"]] = r["entry"]
    return out


def fit_heads(splits: DataFrame, names: Sequence[str] = FEATURES, l2: float = L2, steps: int = 50) -> dict[str, Head]:
    """One model for each head with both classes, fitted on the training part.

    Minimises mean loss plus ``l2`` / 2 times the squared weights of standardised features, without
    the intercept's, by reweighted least squares: all heads move in the same scan, each with its own
    step, halved where its loss would rise.  It ends when no gradient is above rounding.
    """
    train = splits.filter(F.col("part") == "train")
    size = len(names) + 1
    weights: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    count: dict[str, float] = {}
    for head, m in _statistics(train, names, None).items():
        n, positive = m[0, 0], m[0, -1]
        if 0 < positive < n:
            mean = m[0, 1:-1] / n
            spread = np.maximum(np.diag(m)[1:-1] - n * mean * mean, 0) / max(n - 1, 1)
            level = np.sqrt(np.where(spread > 1e-24 * (1 + mean * mean), spread, np.inf))
            weights[head], count[head] = (mean, level, np.zeros(size)), n
    penalty = np.full(size, l2)
    penalty[0] = 0
    held: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights, step of the best point so far
    open_ = dict(weights)
    for _ in range(steps):
        if not open_:
            break
        for head, m in _statistics(train, names, open_).items():
            w, n = open_[head][2], count[head]
            loss = m[-1, -1] / n + penalty @ (w * w) / 2
            if head in held and not loss <= held[head][0] + 1e-12:
                best, at, move = held[head]
                held[head] = (best, at, move / 2)
                w = at + move / 2
            else:
                gradient = m[:-1, -1] / n + penalty * w
                move = -np.linalg.solve(m[:-1, :-1] / n + np.diag(penalty) + 1e-12 * np.eye(size), gradient)
                held[head] = (loss, w, move)
                weights[head] = (*weights[head][:2], w)
                if np.abs(gradient).max() < 1e-9:
                    del open_[head]
                    continue
                w = w + move
            open_[head] = (*open_[head][:2], w)
    out = {}
    for head in HEADS if set(weights) <= set(HEADS) else sorted(weights):
        if head in weights:
            mean, level, w = weights[head]
            plain = w[1:] / level
            out[head] = Head(tuple(names), float(w[0] - plain @ mean), tuple(plain.tolist()))
    return out


def fit_head(train: DataFrame, names: Sequence[str] = FEATURES, l2: float = L2) -> Head | None:
    """The model of a single population with its ``label``; None without both classes."""
    return fit_heads(train.withColumns({"head": F.lit("one"), "part": F.lit("train")}), names, l2).get("one")


def gradients(models: dict[str, Head], splits: DataFrame, l2: float = L2) -> DataFrame:
    """head, samples, positives and the largest entry of the penalised loss's gradient over the training part.

    Without models, as where no head has both classes, there are no rows.
    """
    if not models:
        return splits.sparkSession.createDataFrame([], "samples long, positives long, gradient double, head string")
    train = splits.filter(F.col("part") == "train")
    out = None
    names = next(iter(models.values())).names
    spread = train.groupBy("head").agg(*[f(F.col(n)).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev))])
    joined = train.join(F.broadcast(spread), "head")  # one row a head
    for head, model in models.items():
        off = model.probability() - F.col("label")
        terms = [F.avg(off)]
        for name, weight in zip(model.names, model.weights):
            level = F.nullif(F.max(f"s_{name}"), F.lit(0.0))
            terms.append(F.coalesce(F.avg(off * (F.col(name) - F.col(f"m_{name}"))) / level + l2 * weight * level, F.lit(0.0)))
        one = joined.filter(F.col("head") == head).agg(
            F.count(F.lit(1)).alias("samples"), F.sum(F.col("label").cast("long")).alias("positives"), F.greatest(*[F.abs(t) for t in terms]).alias("gradient"))
        one = one.withColumn("head", F.lit(head))
        out = one if out is None else out.unionByName(one)
    return out


def score_signals(models: dict[str, Head], signals: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Predictions of every head; with ``done``, only for signals that have none yet."""
    rows = signals if done is None else signals.join(done.select("signal_id"), "signal_id", "left_anti")
    rows = rows.select("signal_id", *feature_columns())
    for head, model in models.items():
        rows = predict(model, rows, f"{head}_probability")
    return rows.select("signal_id", *[f"{head}_probability" for head in models])


def retrain_decision(eligible: int, trained_on: int | None, threshold: int = TRAINING_THRESHOLD) -> str:
    """BELOW_THRESHOLD, SCORE_MISSING (nothing new to learn) or TRAIN."""
    if eligible < threshold:
        return "BELOW_THRESHOLD"
    return "SCORE_MISSING" if trained_on == eligible else "TRAIN"


def base_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("label").alias("base_rate"))


def decision_stump(train: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Best single feature split at its median: feature, threshold, loss and the two leaf rates."""
    order = {name: k for k, name in enumerate(names)}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n, k in order.items()])
    long = train.select("label", F.explode(pairs).alias("_p")).select("label", "_p.k", "_p.feature", "_p.value")
    cuts = exact_quantiles(long, ["feature"], "value", {"threshold": (0.5, "linear")})
    above = F.col("value") >= F.col("threshold")
    scored = long.join(F.broadcast(cuts), "feature").groupBy("k", "feature", "threshold").agg(  # one row per feature
        F.avg(F.pow(above.cast("int") - F.col("label"), F.lit(2))).alias("loss"),
        F.avg(F.when(~above, F.col("label"))).alias("_left"), F.avg(F.when(above, F.col("label"))).alias("_right"),
        F.avg("label").alias("_base"),
    )
    best = scored.agg(F.min(F.struct("loss", "k", "feature", "threshold", "_left", "_right", "_base")).alias("_b"))
    return best.select(
        "_b.feature", "_b.threshold", "_b.loss", F.coalesce("_b._left", "_b._base").alias("left_rate"), F.coalesce("_b._right", "_b._base").alias("right_rate"))


def classification_metrics(rows: DataFrame, probability: str = "p", label: str = "label") -> DataFrame:
    """Areas under ROC and precision-recall, Brier score, log loss, precision, recall and F1.

    Equal probabilities form one point of the curves, so the result does not depend on row order;
    without ties it is the usual trapezoid sum.
    """
    p = F.least(F.greatest(F.col(probability), F.lit(CLIP)), F.lit(1 - CLIP))
    y = F.col(label).cast("int")
    points = rows.groupBy(p.alias("_p")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    slices = F.floor((1 - F.col("_p")) * 65536)
    curve = running(points, [], [F.desc("_p")], slices, {"_tp": ("_pos", "sum"), "_fp": ("_neg", "sum")})
    totals = points.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    tp0, fp0 = F.col("_tp") - F.col("_pos"), F.col("_fp") - F.col("_neg")
    seen0 = tp0 + fp0
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    before = F.when(seen0 == 0, F.lit(1.0)).otherwise(tp0 / F.nullif(seen0, F.lit(0)))
    areas = curve.agg(
        F.sum(F.col("_neg") * (F.col("_tp") + tp0) / 2).alias("_roc"), F.sum(F.col("_pos") * (precision + before) / 2).alias("_pr"))
    said = p >= 0.5
    basic = rows.agg(
        F.avg(F.pow(p - y, F.lit(2))).alias("brier_score"), (-F.avg(F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"),
        F.count_if(said & (y == 1)).alias("_t"), F.count_if(said & (y == 0)).alias("_f"), F.count_if(~said & (y == 1)).alias("_m"),
    )
    out = areas.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(basic))  # one row each

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    t, f, m = F.col("_t"), F.col("_f"), F.col("_m")
    return out.select(
        ratio(F.col("_roc"), F.col("_P") * F.col("_N")).alias("roc_auc"), ratio(F.col("_pr"), F.col("_P")).alias("pr_auc"),
        "brier_score", "log_loss", ratio(t, t + f).alias("precision"), ratio(t, t + m).alias("recall"), ratio(2 * t, 2 * t + f + m).alias("f1"))


def calibration(rows: DataFrame, probability: str = "p", label: str = "label") -> DataFrame:
    """Ten bins with count, mean probability and hit rate; empty bins are left out.

    The lower edges are the floating-point multiples of 0.1 (so 0.3 is in the third bin, and 0.6
    and 1.0 are in none).
    """
    p = F.col(probability)
    lower = F.lit(None).cast("double")
    for k in range(10):
        edge = k * 0.1
        lower = F.when((p >= edge) & (p < edge + 0.1), F.lit(edge)).otherwise(lower)
    binned = rows.withColumn("lower", lower).filter(F.col("lower").isNotNull())
    return binned.groupBy("lower").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("hit_rate"),
    ).withColumn("upper", F.col("lower") + 0.1)


def probability_quality(rows: DataFrame, probability: str = "p", label: str = "label") -> DataFrame:
    """Whether probabilities may be shown as such (one row)."""
    bins = calibration(rows, probability, label)
    full = F.col("count") >= 10
    gate = bins.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("sample"), F.count_if(full).alias("_bins"),
        F.max(F.when(full, F.abs(F.col("mean_probability") - F.col("hit_rate")))).alias("max_calibration_gap"))
    p, y = F.least(F.greatest(F.col(probability), F.lit(CLIP)), F.lit(1 - CLIP)), F.col(label)
    rates = rows.agg(F.avg(F.pow(p - y, F.lit(2))).alias("_brier"), F.avg(y.cast("double")).alias("_rate"), F.count_distinct(label).alias("_classes"))
    out = gate.crossJoin(F.broadcast(rates)).withColumn(  # one row each
        "beats_base_rate_brier", F.col("_brier") < F.col("_rate") * (1 - F.col("_rate")))
    good = (F.col("sample") >= 50) & (F.col("_bins") >= 2) & F.col("beats_base_rate_brier") & (F.coalesce("max_calibration_gap", F.lit(1.0)) <= 0.15)
    status = F.when(F.col("_classes") < 2, "INSUFFICIENT_CLASS_VARIATION").when(good, "CALIBRATED").otherwise("UNCALIBRATED")
    return out.select(
        status.alias("status"), F.when((F.col("_classes") >= 2) & good, "PROBABILITY").otherwise("SHADOW_SCORE").alias("display"),
        "sample", "max_calibration_gap", "beats_base_rate_brier")
