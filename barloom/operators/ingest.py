"""Ingestion: classify, convert, merge, hash and summarise incoming bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import completed_intraday, ohlc_broken, split_valid
from barloom.schema import EXCHANGE_ZONE, IDENTITY, TIMEFRAME_SECONDS, VALUES
from barloom.series import SLICE_BARS, blocked, epoch_slice, number_bars


def classify(incoming: DataFrame, existing: DataFrame | None = None, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Copies of each (identity, values) with ``new_rows``, ``duplicates`` and ``revisions``.

    The first value seen is kept; a stored bar always wins.  Copies collapse before the shuffle, so
    a bar that was sent a billion times is a handful of rows.
    """
    rows = incoming.select(*identity, *VALUES, F.col("ingest_seq").alias("_seq"), F.lit(1).alias("_new"))
    if existing is not None:
        stored = existing.select(*identity, *VALUES, F.lit(-1).cast("long").alias("_seq"), F.lit(0).alias("_new"))
        rows = rows.unionByName(stored)
    collapsed = rows.groupBy(*identity, *VALUES).agg(
        F.sum("_new").alias("received"), F.min("_seq").alias("first_seq"), F.min("_new").alias("_new_only"),
    )
    first = collapsed.groupBy(*identity).agg(F.min("first_seq").alias("_kept_seq"))
    marked = collapsed.join(first, list(identity)).withColumn("kept", F.col("first_seq") == F.col("_kept_seq"))
    added = F.when(F.col("kept") & (F.col("_new_only") == 1), 1).otherwise(0)
    return marked.withColumns({
        "new_rows": added,
        "duplicates": F.when(F.col("kept"), F.col("received") - added).otherwise(0),
        "revisions": F.when(~F.col("kept"), F.col("received")).otherwise(0),
    }).drop("_kept_seq", "_new_only")


def ingest_metrics(incoming: DataFrame, existing: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """One row: received, valid, invalid, new, duplicate and revised bars, and quality percent.

    A dry run stores nothing: it only sees copies of bars stored before.
    """
    valid, bad = split_valid(incoming)
    if dry_run:
        if existing is None:
            counts = valid.agg(F.count(F.lit(1)).alias("new_bars")).withColumns(
                {"duplicate_bars": F.lit(0).cast("long"), "revised_bars": F.lit(0).cast("long")}
            )
        else:
            old = existing.select(*IDENTITY, F.struct(*VALUES).alias("_old"))
            joined = valid.join(old, list(IDENTITY), "left")
            same = F.struct(*VALUES) == F.col("_old")
            known = F.col("_old").isNotNull()
            counts = joined.agg(
                F.count_if(~known).alias("new_bars"), F.count_if(known & same).alias("duplicate_bars"),
                F.count_if(known & ~same).alias("revised_bars"),
            )
    else:
        counts = classify(valid, existing).agg(
            F.sum("new_rows").alias("new_bars"), F.sum("duplicates").alias("duplicate_bars"),
            F.sum("revisions").alias("revised_bars"),
        )
    invalid = bad.agg(F.count(F.lit(1)).alias("invalid_bars"))
    out = counts.crossJoin(F.broadcast(invalid))
    valid_bars = F.col("new_bars") + F.col("duplicate_bars") + F.col("revised_bars")
    received = valid_bars + F.col("invalid_bars")
    return out.select(
        received.alias("bars_received"), valid_bars.alias("bars_valid"), "invalid_bars", "new_bars",
        "duplicate_bars", "revised_bars",
        F.when(received > 0, valid_bars / received * 100).otherwise(0.0).alias("quality_percent"),
    )


def merge_incremental(existing: DataFrame, incoming: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Stored bars plus first-seen new ones; nothing stored is revised."""
    stored = existing.select(*identity, *VALUES)
    fresh = incoming.groupBy(*identity).agg(
        F.min_by(F.struct(*VALUES), F.col("ingest_seq")).alias("_first")
    ).select(*identity, *[F.col(f"_first.{v}").alias(v) for v in VALUES])
    return stored.unionByName(fresh.join(stored.select(*identity), list(identity), "left_anti"))


def next_start(bars: DataFrame, fallback: Column) -> DataFrame:
    return bars.agg(F.coalesce(F.max("ts"), fallback).alias("next_start"))


def next_starts(symbols: DataFrame, bars: DataFrame, fallback: Column) -> DataFrame:
    """Where each symbol's next download starts: at its last bar, or at ``fallback`` while it has none."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return symbols.select("symbol").distinct().join(last, "symbol", "left").select("symbol", F.coalesce("_last", fallback).alias("next_start"))


def manifest(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count_distinct("symbol").alias("symbols"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("rows"), F.bool_and("is_adjusted").alias("all_adjusted"),
    )


def _micro(name: str) -> Column:
    return F.round(F.col(name) * 1_000_000).cast("long")


def dataset_hash(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Order-free SHA-256 of a set of bars, built in levels: slice of a symbol, symbol, the 4,096
    groups of symbols whose hash starts alike, data set.

    A level-one group is one slice of one symbol, so at most SLICE_BARS bars (per copy).
    """
    line = F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string"), *[_micro(v).cast("string") for v in VALUES])
    rows = bars.select("symbol", epoch_slice("ts", step_seconds * SLICE_BARS).alias("_slice"), F.sha2(line, 256).alias("_h"))

    def fold(frame: DataFrame, *keys: str | Column) -> DataFrame:
        joined = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("_h"))), 256).alias("_h")
        return frame.groupBy(*keys).agg(joined)

    symbols = fold(fold(rows, "symbol", "_slice"), "symbol")
    return fold(fold(symbols, F.substring("_h", 1, 3).alias("_p"))).select(F.col("_h").alias("dataset_hash"))


# --- vendor conversion -----------------------------------------------------------------------

# Reasons in the order they are tested.
CONVERT_REASONS = (
    "TIMESTAMP_ERROR", "NAN_OHLCV", "INVALID_NUMERIC", "NON_POSITIVE_PRICE", "NEGATIVE_VOLUME", "OHLC_INCONSISTENCY",
)


def convert(raw: DataFrame, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Vendor rows (text values, local time text) to typed bars with the first failing reason.

    Reads symbol, local_time, the five values as text, and ingest_seq; of rows with the same symbol
    and time the first to arrive is kept, the others are counted in ``copies``.
    """
    once = raw.groupBy("symbol", "local_time").agg(
        F.min_by(F.struct(*VALUES), F.col("ingest_seq")).alias("_v"), F.count(F.lit(1)).alias("copies")
    )
    typed = once.select(
        "symbol", "copies",
        F.to_utc_timestamp(F.try_to_timestamp("local_time", F.lit("yyyy-MM-dd HH:mm:ss")), zone).alias("ts"),
        *[F.col(f"_v.{v}").alias(f"_{v}") for v in VALUES],
        *[F.col(f"_v.{v}").try_cast("double").alias(v) for v in VALUES],
    )
    missing, unreadable = F.lit(False), F.lit(False)
    for v in VALUES:
        missing = missing | F.col(f"_{v}").isNull() | (F.lower(f"_{v}") == "nan")
        unreadable = unreadable | F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    reason = (
        F.when(F.col("ts").isNull(), "TIMESTAMP_ERROR")
        .when(missing, "NAN_OHLCV").when(unreadable, "INVALID_NUMERIC")
        .when(F.least("open", "high", "low", "close") <= 0, "NON_POSITIVE_PRICE")
        .when(F.col("volume") < 0, "NEGATIVE_VOLUME").when(ohlc_broken(), "OHLC_INCONSISTENCY")
    )
    return typed.withColumn("reason", reason).select("symbol", "ts", *VALUES, "copies", "reason")


def conversion_quality(converted: DataFrame, timeframe: str, start: Column, end: Column) -> DataFrame:
    """Per symbol: counts by outcome, zero volume, large gaps, range completeness and quality score."""
    clean = converted.filter(F.col("reason").isNull())
    s = blocked(number_bars(clean, TIMEFRAME_SECONDS[timeframe]), halo=1)
    gap = F.abs(F.col("open") / F.lag("close").over(s.w) - 1) > 0.25
    gaps = s.add({"_gap": gap}).rows().groupBy("symbol").agg(
        F.count_if("_gap").alias("large_gaps"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"),
    )
    counts = converted.groupBy("symbol").agg(
        F.sum("copies").alias("bars_received"), F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count_if(F.col("reason").isNull()).alias("bars_valid"),
        *[F.count_if(F.col("reason") == name).alias(name.lower()) for name in CONVERT_REASONS],
    )
    invalid = sum((F.col(name.lower()) for name in CONVERT_REASONS), F.lit(0))
    out = counts.join(gaps, "symbol", "left").withColumn("invalid", invalid)
    score = (F.col("bars_received") - F.col("invalid") - F.col("duplicates")) / F.col("bars_received") * 100
    week = F.expr("INTERVAL 7 DAYS")
    incomplete = (F.to_date("first_timestamp") > F.to_date(start + week)) | (
        F.to_date("last_timestamp") < F.to_date(end - week)
    )
    return out.withColumns({
        "quality_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)),
        "range_incomplete": F.coalesce(incomplete, F.lit(False)),
    })


def download_report(quality: DataFrame) -> DataFrame:
    """Totals over symbols and the overall score."""
    totals = quality.agg(
        F.count(F.lit(1)).alias("found_symbols"), F.sum("bars_valid").alias("valid_bars"),
        F.sum("invalid").alias("invalid_bars"), F.sum("duplicates").alias("duplicates"),
        *[F.sum(name.lower()).alias(name.lower()) for name in CONVERT_REASONS],
    )
    share = F.col("valid_bars") / F.greatest(F.lit(1), F.col("valid_bars") + F.col("invalid_bars")) * 100
    return totals.withColumn("quality_score", share)


def update_summary(
    downloaded: DataFrame, stored: DataFrame, now: Column, minutes: int = 15, stale_minutes: int = 45
) -> DataFrame:
    """One row: completed and inserted bars, latest times, freshness and the leading reason."""
    done = completed_intraday(F.col("ts"), minutes, now)
    staged = downloaded.agg(
        F.count(F.lit(1)).alias("downloaded"), F.count_if(done).alias("completed"),
        F.count_distinct("symbol").alias("found_symbols"),
        F.max("ts").alias("latest_provider"), F.max(F.when(done, F.col("ts"))).alias("latest_completed"),
    )
    moved = classify(downloaded.filter(done), stored).agg(
        F.coalesce(F.sum("new_rows"), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.col("duplicates") + F.col("revisions")), F.lit(0)).alias("duplicates"),
    )
    before = stored.agg(F.max("ts").alias("_stored"))
    out = staged.crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(before))
    out = out.withColumn("latest_persisted", F.greatest("_stored", "latest_completed"))
    fresh = F.unix_micros(now) - F.unix_micros("latest_persisted") <= stale_minutes * 60_000_000
    out = out.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    reason = (
        F.when(F.col("found_symbols") == 0, "PROVIDER_EMPTY")
        .when(F.col("completed") == 0, "NO_COMPLETED_BARS")
        .when(~F.col("fresh"), "PROVIDER_OLD_BARS_ONLY")
    )
    return out.withColumn("reason", reason).drop("_stored")


# --- latency ---------------------------------------------------------------------------------

def latency_seconds() -> Column:
    return (F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6
