"""Next-bar entries, first-touch exits and profit and loss, all set-based.

Sizing uses a fixed equity; a shared account with position caps would be a sequential simulation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import corporate_action
from barloom.operators.risk import EQUITY, position_size
from barloom.operators.scoring import DAILY_STRATEGY

# Cost model and entry gates of the paper account.
COMMISSION_BPS = 10.0
SLIPPAGE_BPS = 5.0
MAX_ENTRY_GAP_PERCENT = 3.0
MIN_QUALITY = 90
PORTFOLIO = "paper-default"
BLOCK = 64
#: Blocks under one summary row of the next level.
FAN = 64


def next_bar(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with the open of the following bar; null when there is none yet."""
    after = bars.select(
        "symbol", (F.col("bar_no") - 1).alias("bar_no"), F.col("ts").alias("entry_time"), F.col("open").alias("entry_open")
    )
    return signals.join(after, ["symbol", "bar_no"], "left")


def gate_entries(orders: DataFrame, bars: DataFrame, min_score: int = 80, equity: float = EQUITY) -> DataFrame:
    """Orders with ``result``: why they were refused, or TRADE_OPENED; PENDING_ENTRY without a next bar."""
    closes = bars.select("symbol", "bar_no", F.col("close").alias("signal_close"))
    rows = next_bar(orders, bars).join(closes, ["symbol", "bar_no"], "left")
    opening = F.col("entry_open")
    quantity = position_size(F.lit(equity), opening, F.col("stop"))
    gap = F.abs(opening / F.nullif("expected_entry", F.lit(0.0)) - 1) * 100
    result = (
        F.when(F.col("score") < min_score, "REJECTED_LOW_SCORE")
        .when(F.col("data_quality") < MIN_QUALITY, "REJECTED_LOW_DATA_QUALITY")
        .when(opening.isNull(), "PENDING_ENTRY")
        .when(corporate_action(opening, F.col("signal_close")), "REJECTED_CORPORATE_ACTION")
        .when(gap > MAX_ENTRY_GAP_PERCENT, "REJECTED_ENTRY_GAP")
        .when(quantity.isNull() | (quantity <= 0), "REJECTED_PORTFOLIO_RISK")
        .otherwise("TRADE_OPENED")
    )
    return rows.withColumns({"quantity": quantity, "result": result})


def open_trades(gated: DataFrame, equity: float = EQUITY, strategy: str = DAILY_STRATEGY, slippage_bps: float = SLIPPAGE_BPS) -> DataFrame:
    """Filled entries with their cost; ids are deterministic."""
    fill = F.col("entry_open") * (1 + slippage_bps / 10_000)
    stamp = F.date_format("signal_time", "yyyy-MM-dd'T'HH:mm:ss+00:00")
    return gated.filter(F.col("result") == "TRADE_OPENED").select(
        F.sha2(F.concat_ws("|", F.lit(strategy), "symbol", stamp), 256).alias("trade_id"),
        "signal_id", F.lit(PORTFOLIO).alias("portfolio_id"), F.lit(strategy).alias("strategy_id"), "symbol", "signal_time",
        "entry_time", (F.col("bar_no") + 1).alias("entry_bar"), fill.alias("entry_price"), "stop", "target_1", "target_2",
        F.col("quantity").cast("double").alias("quantity"), F.lit(equity).alias("equity_before"),
        (F.col("quantity") * (fill - F.col("stop"))).alias("initial_risk"),
        ((fill - F.col("entry_open")) * F.col("quantity")).alias("entry_slippage"), "regime",
    )


def _touch() -> Column:
    """Reason and raw fill of the first rule a bar meets; null when it meets none."""
    o, high, low, stop = F.col("open"), F.col("high"), F.col("low"), F.col("stop")
    t1, t2 = F.col("target_1"), F.col("target_2")

    def out(reason: str, fill: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), fill.alias("fill"))

    return (
        F.when(o <= stop, out("STOP_GAP", o)).when(o >= t2, out("TARGET_2_GAP", o))
        .when((low <= stop) & (high >= t1), out("STOP_FIRST_AMBIGUITY", stop)).when(low <= stop, out("STOP", stop))
        .when(high >= t2, out("TARGET_2", t2)).when(high >= t1, out("TARGET_1", t1))
    )


def first_exits(trades: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """trade_id with exit_time, exit_reason and raw_fill of the first bar after entry that closes it.

    Most exits are near: the rest of the entry's block and the next block are searched bar by bar.
    The others look at later blocks through summary rows (lowest low, highest high) of blocks, of 64
    blocks, of 64 times 64, and so on: up the levels until one can close the trade, down again to its
    first block, then at that block's bars.  A trade meets at most 64 rows per level, however long the
    history.  Every join is an equi-join on (symbol, block), so a symbol with much history or many
    trades spreads over its blocks.
    """
    side = bars.select("symbol", F.floor(F.col("bar_no") / block).alias("_block"), "bar_no", F.col("ts").alias("exit_time"), "open", "high", "low")
    want = trades.select("trade_id", "symbol", "entry_bar", "stop", "target_1", "target_2", F.floor((F.col("entry_bar") + 1) / block).alias("_home"))

    def search(candidates: DataFrame) -> DataFrame:
        hits = candidates.join(side, ["symbol", "_block"]).filter(F.col("bar_no") > F.col("entry_bar")).withColumn("_hit", _touch())
        hits = hits.filter(F.col("_hit").isNotNull())
        return hits.groupBy("trade_id").agg(F.min_by(F.struct("exit_time", "_hit"), F.col("bar_no")).alias("_f")).select(
            "trade_id", "_f.exit_time", F.col("_f._hit.reason").alias("exit_reason"), F.col("_f._hit.fill").alias("raw_fill"))

    near = search(want.withColumn("_block", F.explode(F.sequence(F.col("_home"), F.col("_home") + 1))))
    rest = want.join(near, "trade_id", "left_anti")
    chosen = _closing_block(rest.withColumn("_from", F.col("_home") + 2), side)
    far = search(rest.join(chosen, "trade_id"))
    return near.unionByName(far)


def _closing_block(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trade_id and the first ``_block`` from ``_from`` on that reaches its stop or first target."""
    levels = [bars.groupBy("symbol", "_block").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))]
    most = levels[0].agg(F.max("_block")).first()[0] or 0
    while most >= FAN:
        most //= FAN
        above = levels[-1].withColumn("_block", F.floor(F.col("_block") / FAN))
        levels.append(above.groupBy("symbol", "_block").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")))

    def first(candidates: DataFrame, level: DataFrame) -> DataFrame:
        reached = (F.col("_low") <= F.col("stop")) | (F.col("_high") >= F.col("target_1"))
        return candidates.join(level, ["symbol", "_block"]).filter(reached).groupBy("trade_id").agg(F.min("_block").alias("_block"))

    todo = trades.select("trade_id", "symbol", "stop", "target_1", "_from")
    plain = todo.drop("_from")
    found = []
    for level in levels:  # up: the rest of the blocks under the same parent
        end = (F.floor(F.col("_from") / FAN) + 1) * FAN - 1
        here = first(todo.withColumn("_block", F.explode(F.sequence("_from", end))), level)
        found.append(here)
        todo = todo.join(here, "trade_id", "left_anti").withColumn("_from", F.floor(F.col("_from") / FAN) + 1)
    for k in range(len(levels) - 1, 0, -1):  # down: the children of the block found
        inside = plain.join(found[k], "trade_id").withColumn("_block", F.explode(F.sequence(F.col("_block") * FAN, F.col("_block") * FAN + FAN - 1)))
        found[k - 1] = found[k - 1].unionByName(first(inside, levels[k - 1]))
    return found[0]


def close_trades(trades: DataFrame, exits: DataFrame, commission_bps: float = COMMISSION_BPS, slippage_bps: float = SLIPPAGE_BPS) -> DataFrame:
    """Trades with exit price, gross and net result; open trades keep nulls."""
    rows = trades.join(exits, "trade_id", "left")
    fill = F.col("raw_fill") * (1 - slippage_bps / 10_000)
    rows = rows.withColumn("exit_price", fill)
    quantity = F.col("quantity")
    gross = (F.col("exit_price") - F.col("entry_price")) * quantity
    commission = (F.col("entry_price") + F.col("exit_price")) * quantity * commission_bps / 10_000
    return rows.withColumns({
        "gross_pnl": gross, "commission": commission,
        "slippage": F.col("entry_slippage") + F.coalesce((F.col("raw_fill") - F.col("exit_price")) * quantity, F.lit(0.0)),
        "net_pnl": gross - commission,
        "state": F.when(F.col("exit_time").isNotNull(), "CLOSED").otherwise("OPEN"),
    })


def unique_open(trades: DataFrame, keys: Sequence[str] = ("portfolio_id", "strategy_id", "symbol")) -> DataFrame:
    """Open trades that break the rule of one open trade per portfolio, strategy and symbol."""
    still = trades.filter(F.col("exit_time").isNull())
    first = still.groupBy(*keys).agg(F.min_by("trade_id", F.struct("entry_time", "trade_id")).alias("trade_id"))
    return still.join(first.select("trade_id"), "trade_id", "left_anti")


def fingerprint(settings: dict[str, object]) -> Column:
    """SHA-256 of the settings in key order; a setting may be a column."""
    def text(value: object) -> Column:
        return value.cast("string") if isinstance(value, Column) else F.lit(str(value))

    return F.sha2(F.to_json(F.struct(*[text(settings[k]).alias(k) for k in sorted(settings)])), 256)


def extremes(trades: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst closed trades by (net result, id)."""
    closed = trades.filter(F.col("exit_time").isNotNull()).select("trade_id", "symbol", "net_pnl")
    best = closed.orderBy(F.desc("net_pnl"), F.desc("trade_id")).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(closed.orderBy("net_pnl", "trade_id").limit(n).withColumn("side", F.lit("worst")))
