"""Equity curves, risk metrics and trade statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.recursive import add_means
from barloom.operators.risk import EQUITY
from barloom.operators.trades import COMMISSION_BPS, SLIPPAGE_BPS
from barloom.quantiles import exact_quantiles
from barloom.series import blocked, number_bars, running

# Trading days per year and the length of a year.
ANNUAL = 252
YEAR_SECONDS = 365.2425 * 86400


def _time_slice(column: str, days: int = 1) -> Column:
    return F.floor(F.unix_micros(column) / (days * 86_400_000_000))


def realised_curve(trades: DataFrame, equity: float = EQUITY) -> DataFrame:
    """Equity, running peak and drawdown after every exit."""
    closed = trades.filter(F.col("exit_time").isNotNull()).select("trade_id", "exit_time", "net_pnl")
    order = ["exit_time", "trade_id"]
    rows = running(closed, [], order, _time_slice("exit_time"), {"_cum": ("net_pnl", "sum")})
    rows = rows.withColumn("equity", F.lit(equity) + F.col("_cum"))
    rows = running(rows, [], order, _time_slice("exit_time"), {"_peak": ("equity", "max")})
    rows = rows.withColumn("peak", F.greatest(F.lit(equity), "_peak"))
    return rows.select(*order, "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown"))


def marked_curve(
    trades: DataFrame, bars: DataFrame, equity: float = EQUITY,
    commission_bps: float = COMMISSION_BPS, slippage_bps: float = SLIPPAGE_BPS,
) -> DataFrame:
    """Mark-to-market equity per time stamp of any symbol's bar.

    A symbol's contribution is quantity and cost held so far (running sums of entries and exits)
    times its last close, and it changes only at its own bars.  So each bar gives the change since
    the symbol's previous bar, changes are summed per stamp, and one scan over the stamps gives the
    portfolio: no product of stamps with trades or symbols.
    """
    value = F.col("entry_price") * F.col("quantity")
    ins = trades.select("symbol", F.col("entry_time").alias("ts"), F.col("quantity").alias("q"), value.alias("c"), F.lit(1.0).alias("n"))
    outs = trades.filter(F.col("exit_time").isNotNull()).select(
        "symbol", F.col("exit_time").alias("ts"), (-F.col("quantity")).alias("q"), (-value).alias("c"), F.lit(-1.0).alias("n"))
    moves = ins.unionByName(outs).groupBy("symbol", "ts").agg(*[F.sum(x).alias(f"d_{x}") for x in "qcn"])
    rows = bars.select("symbol", "ts", "close", "bar_no").join(moves, ["symbol", "ts"], "left").fillna(0.0, [f"d_{x}" for x in "qcn"])
    s = add_means(blocked(rows, halo=4), [], totals=["d_q", "d_c", "d_n"])
    held, cost = F.col("cum_d_q"), F.col("cum_d_c")
    slip, fee = slippage_bps / 10_000, commission_bps / 10_000
    liquid = F.col("close") * (1 - slip)
    s = s.add({"gross": F.abs(F.col("close") * held), "open_": F.col("cum_d_n"), "unreal": liquid * held * (1 - fee) - cost * (1 + fee)})
    s = s.add({f"x_{c}": F.col(c) - F.coalesce(F.lag(c).over(s.w), F.lit(0.0)) for c in ("gross", "open_", "unreal")})
    stamps = s.rows().groupBy("ts").agg(*[F.sum(f"x_{c}").alias(f"x_{c}") for c in ("gross", "open_", "unreal")])
    booked = trades.filter(F.col("exit_time").isNotNull()).groupBy(F.col("exit_time").alias("ts")).agg(F.sum("net_pnl").alias("x_net"))
    line = stamps.join(booked, "ts", "left").fillna(0.0, ["x_net"])
    line = running(line, [], ["ts"], _time_slice("ts"), {
        "gross_exposure": ("x_gross", "sum"), "_open": ("x_open_", "sum"), "unrealized_pnl": ("x_unreal", "sum"), "_net": ("x_net", "sum")})
    line = line.withColumns({
        "realized_equity": F.lit(equity) + F.col("_net"), "open_positions": F.bround("_open").cast("long"),
    }).withColumn("mtm_equity", F.col("realized_equity") + F.col("unrealized_pnl"))
    line = running(line, [], ["ts"], _time_slice("ts"), {"_peak": ("mtm_equity", "max")})
    peak = F.greatest(F.lit(equity), "_peak")
    return line.select(
        "ts", "realized_equity", "mtm_equity", "unrealized_pnl", (F.col("mtm_equity") / peak - 1).alias("drawdown"), "gross_exposure",
        F.coalesce(F.col("gross_exposure") / F.nullif("mtm_equity", F.lit(0.0)) * 100, F.lit(0.0)).alias("gross_exposure_percent"),
        "open_positions",
    )


def daily_risk(curve: DataFrame, step_seconds: int = 86400) -> DataFrame:
    """Max drawdown, Sharpe with the sample deviation, Sortino with the root mean square of losses."""
    s = blocked(number_bars(curve.withColumn("_all", F.lit(0)), step_seconds, keys=("_all",)), halo=1, keys=("_all",))
    rows = s.add({"r": F.col("mtm_equity") / F.lag("mtm_equity").over(s.w) - 1}).rows()
    out = rows.agg(
        F.min("drawdown").alias("_dd"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_sd"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), F.lit(2.0))))).alias("_down"),
    )
    scale = math.sqrt(ANNUAL)

    def ratio(down: str) -> Column:
        return F.coalesce(F.col("_m") / F.nullif(down, F.lit(0.0)) * scale, F.lit(0.0))

    return out.select(
        F.coalesce("_dd", F.lit(0.0)).alias("max_drawdown"), ratio("_sd").alias("sharpe_ratio"), ratio("_down").alias("sortino_ratio"))


def exposure(curve: DataFrame) -> DataFrame:
    return curve.agg(
        F.avg("gross_exposure_percent").alias("average_gross_percent"), F.max("gross_exposure_percent").alias("peak_gross_percent"),
        (F.avg((F.col("open_positions") > 0).cast("int")) * 100).alias("time_invested_percent"),
        F.avg("open_positions").alias("average_open_positions"),
    )


def period_returns(curve: DataFrame, trades: DataFrame, warmup: int = 200, equity: float = EQUITY, step_seconds: int = 86400) -> DataFrame:
    """Years and CAGR over the data set, the eligible part and since the first trade."""
    numbered = number_bars(curve.withColumn("_all", F.lit(0)), step_seconds, keys=("_all",))
    spans = numbered.agg(
        F.min("ts").alias("dataset"), F.max("ts").alias("end"),
        F.max(F.when(F.col("bar_no") <= warmup - 1, F.col("ts"))).alias("eligible"), F.max_by("mtm_equity", "ts").alias("_final"),
    ).crossJoin(F.broadcast(trades.agg(F.min("entry_time").alias("first_trade"))))  # one row each
    parts = F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("start")) for p in ("dataset", "eligible", "first_trade")])
    rows = spans.withColumn("_p", F.explode(parts)).select("_p.period", "_p.start", "end", (F.col("_final") / equity - 1).alias("total_return"))
    years = F.greatest((F.unix_micros("end") - F.unix_micros("start")) / 1e6 / YEAR_SECONDS, F.lit(1 / 365.2425))
    cagr = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1).otherwise(-1.0)
    return rows.withColumn("years", years).withColumn("cagr", F.when(F.col("start").isNotNull(), cagr))


def trade_metrics(returns: DataFrame, order: list[str], slice_by: Column, years: float = 1.0, value: str = "r", days: str = "days") -> DataFrame:
    """Compounded return, rates, averages, drawdown, ratios and streaks of an ordered return list.

    A ratio over no deviation is 0; the two deviations tell such a 0 from a mean of 0.
    """
    r = F.col(value)
    rows = returns.withColumns({
        "_g": 1 + r, "_win": (r > 0).cast("int"), "_loss": (r <= 0).cast("int"),
    })
    rows = running(rows, [], order, slice_by, {"_eq": ("_g", "product"), "_wins": ("_win", "sum"), "_losses": ("_loss", "sum")})
    peaked = running(rows, [], order, slice_by, {"_peak": ("_eq", "max")})
    base = peaked.agg(
        F.count(F.lit(1)).alias("number_of_trades"), F.avg("_win").alias("win_rate"), F.avg("_loss").alias("loss_rate"),
        F.avg(F.when(r > 0, r)).alias("average_win"), F.avg(F.when(r <= 0, r)).alias("average_loss"), F.avg(r).alias("expectancy"),
        F.sum(F.when(r > 0, r)).alias("_gain"), F.sum(F.when(r <= 0, r)).alias("_cost"), F.stddev_pop(r).alias("_sd"),
        F.stddev_pop(F.when(r < 0, r)).alias("_down"), F.min(F.col("_eq") / F.greatest(F.lit(1.0), "_peak") - 1).alias("_dd"),
        F.avg(days).alias("average_trade_duration"), (F.product("_g") - 1).alias("total_return"),
    )
    # A streak of wins shares the number of losses before it, and the other way round.
    win_runs = peaked.filter(r > 0).groupBy("_losses").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_w"))
    loss_runs = peaked.filter(r <= 0).groupBy("_wins").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_l"))
    out = base.crossJoin(F.broadcast(win_runs)).crossJoin(F.broadcast(loss_runs))  # one row each
    scale = math.sqrt(ANNUAL)

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    total = zero(F.col("total_return"))  # nothing is won or lost without trades
    return out.select(
        total.alias("total_return"),
        F.when(total > -1, F.pow(1 + total, F.lit(1 / years)) - 1).otherwise(-1.0).alias("cagr"),
        zero(F.col("win_rate")).alias("win_rate"), zero(F.col("loss_rate")).alias("loss_rate"), zero(F.col("average_win")).alias("average_win"),
        zero(F.col("average_loss")).alias("average_loss"), zero(F.col("expectancy")).alias("expectancy"),
        F.when(zero(F.col("_cost")) == 0, float("inf")).otherwise(zero(F.col("_gain")) / F.abs("_cost")).alias("profit_factor"),
        zero(F.least("_dd", F.lit(0.0))).alias("max_drawdown"),
        zero(F.col("expectancy") / F.nullif("_sd", F.lit(0.0)) * scale).alias("sharpe_ratio"),
        zero(F.col("expectancy") / F.nullif("_down", F.lit(0.0)) * scale).alias("sortino_ratio"),
        "number_of_trades", zero(F.col("average_trade_duration")).alias("average_trade_duration"),
        F.coalesce("_l", F.lit(0)).alias("max_consecutive_losses"), F.coalesce("_w", F.lit(0)).alias("max_consecutive_wins"),
        F.col("_sd").alias("deviation"), F.col("_down").alias("downside_deviation"),
    )


def returns_of(trades: DataFrame) -> DataFrame:
    closed = trades.filter(F.col("exit_time").isNotNull())
    days = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 86_400e6
    return closed.select("trade_id", "exit_time", (F.col("net_pnl") / F.col("equity_before")).alias("r"), days.alias("days"))


def replay_performance(trades: DataFrame, last_processed: Column, equity: float = EQUITY) -> DataFrame:
    """Trade metrics plus R multiples, final equity and exposure."""
    closed = trades.filter(F.col("exit_time").isNotNull())
    base = trade_metrics(returns_of(trades), ["exit_time", "trade_id"], _time_slice("exit_time"))
    multiples = closed.filter(F.col("initial_risk") > 0).withColumn("_r", F.col("net_pnl") / F.col("initial_risk"))
    average = multiples.agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("average_R"))
    median = exact_quantiles(multiples, [], "_r", {"median_R": (0.5, "upper")})
    days = (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 86_400e6
    span = closed.agg(F.sum(days).alias("_held"), F.min("signal_time").alias("_from"), F.sum("net_pnl").alias("net_pnl"))
    out = base.crossJoin(F.broadcast(average)).crossJoin(F.broadcast(span)).join(F.broadcast(median), F.lit(True), "left")  # one row each
    length = F.greatest(F.lit(1.0), (F.unix_micros(last_processed) - F.unix_micros("_from")) / 86_400e6)
    return out.withColumns({
        "median_R": F.coalesce("median_R", F.lit(0.0)), "net_pnl": F.coalesce("net_pnl", F.lit(0.0)),
        "exposure_percent": F.coalesce(F.col("_held") / length * 100, F.lit(0.0)),
    }).withColumn("final_equity", F.lit(equity) + F.col("net_pnl")).drop("_held", "_from")


def grouped_summary(trades: DataFrame) -> DataFrame:
    """Trades, net result, win rate and profit factor by exit year, symbol and regime in one pass."""
    closed = trades.filter(F.col("exit_time").isNotNull()).withColumns({
        "year": F.year("exit_time").cast("string"), "regime": F.coalesce("regime", F.lit("UNKNOWN")),
    })
    kinds = F.array(*[F.struct(F.lit(k).alias("grouping"), F.col(k).alias("member")) for k in ("year", "symbol", "regime")])
    rows = closed.select("net_pnl", F.explode(kinds).alias("_g")).select("net_pnl", "_g.grouping", "_g.member")
    net = F.col("net_pnl")
    out = rows.groupBy("grouping", "member").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(net).alias("net_pnl"), (F.avg((net > 0).cast("int")) * 100).alias("win_rate"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("_gain"), F.coalesce(-F.sum(F.when(net < 0, net)), F.lit(0.0)).alias("_loss"),
    )
    factor = F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).when(F.col("_gain") > 0, F.lit(None)).otherwise(0.0)
    return out.withColumn("profit_factor", factor).drop("_gain", "_loss")
