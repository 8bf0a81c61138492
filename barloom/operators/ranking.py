"""Ordering, top-k, de-duplication and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import latest_rows


def top_candidates(rows: DataFrame, score: str = "score", minimum: int = 70, n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The n best rows of at least ``minimum``, by score, then symbol, then ``ties``."""
    return rows.filter(F.col(score) >= minimum).orderBy(F.desc(score), "symbol", *ties).limit(n)


def newest_per_symbol(rows: DataFrame, score: str = "radar_score", seq: str = "seq") -> DataFrame:
    """Newest row of each upper-cased trimmed symbol (the first of equal times), ranked."""
    clean = rows.withColumn("symbol", F.upper(F.trim("symbol"))).filter(F.col("symbol") != "")
    others = [c for c in clean.columns if c != "symbol"]
    newest = clean.groupBy("symbol").agg(F.max_by(F.struct(*others), F.struct(F.col("ts"), -F.col(seq))).alias("_r"))
    flat = newest.select("symbol", *[F.col(f"_r.{c}").alias(c) for c in others])
    return flat.orderBy(F.desc(score), "symbol")


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars per symbol, oldest first; n is kept within 20 and 500."""
    return latest_rows(bars, min(max(n, 20), 500)).drop("rank").orderBy("symbol", "ts")


def order_entries(orders: DataFrame) -> DataFrame:
    """Execution order: score, quality, reward over risk (all descending), then symbol."""
    reward = (F.col("target_2") - F.col("expected_entry")) / (F.col("expected_entry") - F.col("stop"))
    return orders.withColumn("risk_reward", reward).orderBy(F.desc("score"), F.desc("data_quality"), F.desc("risk_reward"), "symbol", "signal_time")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result; the size is kept within 1 and 100.

    Offset and limit are the feature here: only the rows up to the page's end are gathered.
    """
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def history(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("ts"), "symbol").limit(min(max(limit, 1), 500))


def search(candidates: DataFrame, text: str | None = None, classification: str | None = None, members_only: bool = False) -> DataFrame:
    """Candidates whose symbol contains a text, of a class, optionally index members only."""
    if text:
        candidates = candidates.filter(F.contains(F.upper("symbol"), F.lit(text.upper())))
    if classification:
        candidates = candidates.filter(F.col("classification") == classification)
    return candidates.filter("member") if members_only else candidates


def flag_members(candidates: DataFrame, members: DataFrame, name: str = "member") -> DataFrame:
    """Whether each candidate's symbol is an active member."""
    active = members.filter("active").select("symbol").distinct().withColumn("_in", F.lit(True))
    return candidates.join(active, "symbol", "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")
