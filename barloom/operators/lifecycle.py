"""Setup lifecycle: from a planned signal to its cancellation, entry and exit.

The bar-by-bar rules reduce to first matches inside a setup, so the whole history of a setup is a
handful of window expressions over its at most 24 bars; no group is folded in Python.

* Before entry, the first bar with any decision settles the setup.
* After entry, each way out has a first bar: initial stop, trailing stop, third target, broken
  thesis, time.  The earliest bar wins; inside a bar they rank in that order.
* After the first target the stop moves to the entry price, then trails: the stop in force at a bar
  is a running maximum over the earlier bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.recursive import add_means, span_mean
from barloom.operators.joins import as_of
from barloom.operators.labels import attach_next, completed
from barloom.series import Series


@dataclass(frozen=True)
class Policy:
    """Fixed values of the published policy."""

    version: str = "adaptive-v1-h1-partial-trailing"
    entry_bars: int = 8
    max_holding: int = 16
    min_risk_reward: float = 2.0
    cost_rate: float = 0.001
    chase_r: float = 0.5
    trail_atr: float = 2.0
    weak_momentum: float = -0.01
    thesis_bars: int = 4
    stall_r: float = 0.5


# What to do in each state.
ACTIONS = {
    "DETECTED": "BEKLE",
    "ARMED": "BEKLE",
    "WAITING_PULLBACK": "BEKLE",
    "ENTRY_READY": "ALIM_ICIN_HAZIR",
    "ENTRY_ACTIVATED": "KORU",
    "ACTIVE": "KORU",
    "PROGRESSING": "RISK_AZALT",
    "STALLED": "ZAMAN_CIKISI",
    "CANCELLED_DECAY": "ALMA_SETUP_BOZULDU",
    "CANCELLED_STRUCTURE": "ALMA_SETUP_BOZULDU",
    "EXPIRED": "ALMA_SETUP_BOZULDU",
    "CHASED": "ALMA_GEC_KALINDI",
    "HARD_STOP": "STOP",
    "TRAILING_STOP": "STOP",
    "TIME_EXIT": "ZAMAN_CIKISI",
    "THESIS_INVALIDATED": "TEZ_BOZULDU",
    "H3_REACHED": "HEDEF",
}
HEALTH_GOOD, HEALTH_WEAK, HEALTH_BROKEN, HEALTH_INVALID = "GÜÇLÜ", "ZAYIFLIYOR", "BOZULDU", "GEÇERSİZ"
# Reasons that events carry, and rules by which a stop moves.
HEALTH_REASONS = {
    HEALTH_GOOD: ("Yapı ve momentum iptal eşiğini ihlal etmedi",),
    HEALTH_WEAK: ("Hacim veya momentum sinyal anına göre zayıflıyor",),
    HEALTH_BROKEN: ("Göreli hacim sinyal anına göre belirgin düştü", "Momentum negatif"),
    HEALTH_INVALID: ("Fiyat VWAP ve EMA20 altına indi", "Üç bar momentumu negatif"),
}
FIRST_BAR_REASON = "İlk completed bar bekleniyor"
RISK_REWARD_REASON = "RISK_REWARD_DETERIORATED"
EXIT_REASONS = {"THESIS_INVALIDATED": "Momentum ve VWAP yapısı bozuldu", "TIME_EXIT": "Maksimum holding süresi doldu"}
BREAKEVEN_RULE, TRAIL_RULE = "BREAKEVEN_AFTER_H1", "2_ATR_TRAIL"
SIGNAL_PLAN = "SIGNAL_PLAN"
LEVELS = ("zone_low", "zone_high", "stop", "t1", "t2", "t3")


def context_columns(s: Series) -> Series:
    """Whole-history VWAP, EMA20 without warm-up, 3-bar momentum, 8-bar volume ratio, 14-bar mean range."""
    close, volume = F.col("close"), F.col("volume")
    s = s.add({"tr": ind.true_range(s), "traded": ind.typical_price() * volume})
    before = s.last(8, offset=1)
    base = F.when(F.count("volume").over(before) == 8, F.avg("volume").over(before))
    s = s.add({
        "ctx_momentum": close / F.nullif(ind.lag(s, close, 3), F.lit(0.0)) - 1,
        "ctx_rvol": volume / F.when(base > 0, base),
        "ctx_atr": F.avg("tr").over(s.last(14)),
    })
    s = add_means(s, [span_mean("ctx_ema20", "close", 20, warm=False)], totals=["traded", "volume"])
    return s.add({"ctx_vwap": F.col("cum_traded") / F.nullif("cum_volume", F.lit(0.0))})


def _first(name: str, test: Column, over) -> Column:
    return F.min(F.when(test, F.col("i"))).over(over).alias(name)


def setup_bars(signals: DataFrame, bars: DataFrame, now: Column, policy: Policy = Policy(), data_usable: bool = True) -> DataFrame:
    """Every setup's completed bars with the facts needed to settle it.

    ``signals``: signal_id, symbol, bar_no, ts, rvol and the plan levels; ``bars``: context columns.
    Setups without a complete plan are left out.
    """
    whole = signals
    for level in LEVELS:
        whole = whole.filter(F.col(level).isNotNull())
    base = whole.select("signal_id", "symbol", "bar_no", F.col("ts").alias("signal_time"), F.col("rvol").alias("start_rvol"), *LEVELS)
    rows = attach_next(base, completed(bars, now), policy.entry_bars + policy.max_holding, ("signal_id",))
    setup = Window.partitionBy("signal_id")
    order = setup.orderBy("i")
    close, low, high = F.col("close"), F.col("low"), F.col("high")
    momentum, rvol, start = F.col("ctx_momentum"), F.col("ctx_rvol"), F.col("start_rvol")
    broken = (close < F.col("ctx_vwap")) & (close < F.col("ctx_ema20")) & (momentum < policy.weak_momentum)
    known = (F.col("i") >= 3) & rvol.isNotNull() & start.isNotNull() & momentum.isNotNull()
    decayed = known & (rvol < F.greatest(F.lit(0.5), start * 0.35)) & (momentum < 0)
    weak = known & ((rvol < start * 0.6) | (momentum < 0))
    touched = (low <= F.col("zone_high")) & (high >= F.col("zone_low"))
    chased = close > F.col("zone_high") + (F.col("zone_high") - F.col("stop")) * policy.chase_r
    broken, decayed, weak = (F.coalesce(x, F.lit(False)) for x in (broken, decayed, weak))
    decision = (
        F.when(broken, "CANCELLED_STRUCTURE").when(decayed, "CANCELLED_DECAY")
        .when(F.col("i") >= policy.entry_bars, "EXPIRED").when(chased, "CHASED").when(touched, "ENTRY_READY")
    )
    rows = rows.withColumns({
        "health": F.when(broken, HEALTH_INVALID).when(decayed, HEALTH_BROKEN).when(weak, HEALTH_WEAK).otherwise(HEALTH_GOOD),
        "decision": decision if data_usable else F.lit(None).cast("string"),
        "touched": F.coalesce(touched, F.lit(False)),
        "bars_seen": F.count(F.lit(1)).over(setup),
        "waiting": F.when(close > F.col("zone_high"), "WAITING_PULLBACK").otherwise("ARMED"),
        "next_open": F.lead("open").over(order), "next_ts": F.lead("bar_ts").over(order),
    })
    rows = rows.withColumn("p", F.min(F.when(F.col("decision").isNotNull(), F.struct("i", "decision"))).over(setup))
    ready_at = F.when(F.col("p.decision") == "ENTRY_READY", F.col("p.i") + 1)
    rows = rows.withColumn("open_at", F.max(F.when(F.col("i") == ready_at, F.col("open"))).over(setup))
    risk = F.col("open_at") - F.col("stop")
    reward = (F.col("t1") - F.col("open_at")) / F.nullif(risk, F.lit(0.0))
    gate = (
        F.when(F.col("open_at") > F.col("zone_high") + F.greatest(risk, F.lit(0.0)) * policy.chase_r, "CHASED")
        .when((risk <= 0) | (reward < policy.min_risk_reward), "NO_ENTRY").otherwise("ENTRY_ACTIVATED")
    )
    rows = rows.withColumn("gate", F.when(F.col("open_at").isNotNull(), gate))
    entered = F.col("gate") == "ENTRY_ACTIVATED"
    rows = rows.withColumns({
        "e": F.when(entered, F.col("p.i") + 1), "entry": F.when(entered, F.col("open_at")), "risk": F.when(entered, risk),
    })
    live = F.coalesce(F.col("i") >= F.col("e"), F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "holding": F.when(live, F.col("i") - F.col("e") + 1),
        "mfe": F.greatest(F.lit(0.0), F.max(F.when(live, (high - F.col("entry")) / F.col("risk"))).over(upto)),
        "mae": F.least(F.lit(0.0), F.min(F.when(live, (low - F.col("entry")) / F.col("risk"))).over(upto)),
    })
    rows = rows.select(
        "*", _first("s0", live & (low <= F.col("stop")), setup), _first("h1", live & (high >= F.col("t1")), setup),
        _first("h2", live & (high >= F.col("t2")), setup), _first("h3", live & (high >= F.col("t3")), setup),
    )
    # The first target counts only before the initial stop.
    void = F.coalesce(F.col("s0") <= F.col("h1"), F.lit(False))
    rows = rows.withColumns({h: F.when(~void, F.col(h)) for h in ("h1", "h2", "h3")})
    past = F.coalesce(F.col("i") >= F.col("h1"), F.lit(False))
    trail = F.when(past & F.col("ctx_atr").isNotNull(), F.least(close - F.col("ctx_atr") * policy.trail_atr, close))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "stop_before": F.greatest(F.col("entry"), F.max(trail).over(earlier)),
        "stop_after": F.greatest(F.col("entry"), F.max(trail).over(upto)),
    })
    after_h1 = F.coalesce(F.col("i") > F.col("h1"), F.lit(False))
    thesis = (
        live & (F.col("holding") >= policy.thesis_bars) & ~past
        & (momentum < policy.weak_momentum) & (close < F.col("ctx_vwap"))
    )
    rows = rows.select(
        "*", _first("s1", after_h1 & (low <= F.col("stop_before")), setup),
        _first("k_thesis", F.coalesce(thesis, F.lit(False)), setup),
        _first("k_time", F.coalesce(F.col("holding") >= policy.max_holding, F.lit(False)), setup),
    )
    hard = F.when(F.col("h1").isNull() | (F.col("s0") <= F.col("h1")), F.col("s0"))
    ways = [(hard, 0, "HARD_STOP"), (F.col("s1"), 1, "TRAILING_STOP"), (F.col("h3"), 2, "H3_REACHED"),
            (F.col("k_thesis"), 3, "THESIS_INVALIDATED"), (F.col("k_time"), 4, "TIME_EXIT")]
    candidates = F.array_compact(F.array(*[
        F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(way).alias("way"))) for at, rank, way in ways
    ]))
    return rows.withColumn("x", F.array_min(candidates))


def setups(rows: DataFrame, all_bars: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """One row per setup: state, outcome, entry, exit, stop, targets and metrics.

    Give ``all_bars`` (signal_id, completed_bars) to report bars in trade over all completed bars.
    """
    x_at, way = F.col("x.at"), F.col("x.way")
    by_stop = way.isin("HARD_STOP", "TRAILING_STOP")
    by_open = way.isin("THESIS_INVALIDATED", "TIME_EXIT")
    closing = (F.col("i") == x_at) & by_open & F.col("next_open").isNotNull()

    def reached(k: int) -> Column:
        at = F.col(f"h{k}")
        return at.isNotNull() & F.when(F.col("x").isNull(), F.lit(True)).when(by_stop, at < x_at).otherwise(at <= x_at)

    highest = F.when(reached(3), 3).when(reached(2), 2).when(reached(1), 1).otherwise(0)
    last_live = F.coalesce(x_at, F.lit(10_000))
    kept_stop = (F.col("i") <= last_live) & ~F.coalesce((by_stop | (way == "H3_REACHED")) & (F.col("i") == x_at), F.lit(False))
    one = rows.groupBy("signal_id").agg(
        F.first("symbol").alias("symbol"), F.first("signal_time").alias("signal_time"),
        *[F.first(c).alias(c) for c in ("p", "gate", "e", "entry", "risk", "x", "stop", "t3", "h1", "h2", "h3")],
        F.max("i").alias("bars_seen"),
        F.max_by("waiting", "i").alias("waiting"),
        F.max(F.when(F.col("i") == F.coalesce(F.col("p.i"), F.col("bars_seen")), F.col("health"))).alias("health"),
        F.max(F.when(F.col("i") == F.col("e"), F.col("bar_ts"))).alias("entry_time"),
        F.max(F.when(closing, F.col("next_open"))).alias("close_open"), F.max(F.when(closing, F.col("next_ts"))).alias("close_ts"),
        F.max(F.when(F.col("i") == x_at, F.col("bar_ts"))).alias("x_ts"),
        F.max(F.when(F.col("i") == x_at, F.col("stop_before"))).alias("x_stop"),
        F.max(F.when(F.col("i") <= last_live, F.col("mfe"))).alias("mfe_r"),
        F.min(F.when(F.col("i") <= last_live, F.col("mae"))).alias("mae_r"),
        F.max(F.when(kept_stop, F.col("stop_after"))).alias("_trailed"),
        F.max_by("bar_ts", "i").alias("last_bar"),
        F.max_by(F.struct("holding", "mfe"), F.col("i")).alias("_end"),
    )
    one = one.withColumn("highest_target", highest)
    closed = by_stop | (way == "H3_REACHED") | (by_open & F.col("close_open").isNotNull())
    closed = F.coalesce(closed, F.lit(False))
    price = (
        F.when(way == "HARD_STOP", F.col("stop")).when(way == "TRAILING_STOP", F.col("x_stop"))
        .when(way == "H3_REACHED", F.col("t3")).when(by_open, F.col("close_open"))
    )
    one = one.withColumns({
        "exit_price": F.when(closed, price),
        "exit_time": F.when(closed, F.when(by_open, F.col("close_ts")).otherwise(F.col("x_ts"))),
    }).withColumn("realized_r", (F.col("exit_price") - F.col("entry")) / F.col("risk"))
    real = F.col("realized_r")
    timed = F.when(real > 0.1, "TIME_EXIT_PROFIT").when(real < -0.1, "TIME_EXIT_LOSS").otherwise("TIME_EXIT_FLAT")
    before = F.col("p.decision")
    outcome = (
        F.when(before == "CANCELLED_DECAY", "NO_ENTRY_DECAY").when(before == "CANCELLED_STRUCTURE", "NO_ENTRY_STRUCTURE")
        .when(before == "EXPIRED", "NO_ENTRY_EXPIRED").when((before == "CHASED") | (F.col("gate") == "CHASED"), "CHASED")
        .when(F.col("gate") == "NO_ENTRY", "NO_ENTRY_STRUCTURE")
        .when(~closed, None).when(way == "HARD_STOP", "STOP_BEFORE_H1").when(way == "TRAILING_STOP", "TRAILING_EXIT")
        .when(way == "H3_REACHED", "H3_EXIT").when(way == "THESIS_INVALIDATED", "THESIS_INVALIDATED").when(way == "TIME_EXIT", timed)
    )
    return one.select(
        "signal_id", "symbol", "signal_time", F.lit(policy.version).alias("policy_version"), outcome.alias("outcome"), "health",
        "entry_time", F.col("entry").alias("entry_price"), F.when(F.col("entry").isNotNull(), F.col("stop")).alias("initial_stop"),
        F.when(F.col("entry").isNotNull(), F.when(F.col("highest_target") > 0, F.col("_trailed")).otherwise(F.col("stop"))).alias("active_stop"),
        "exit_time", "exit_price", "highest_target",
        F.coalesce("mfe_r", F.lit(0.0)).alias("mfe_r"), F.coalesce("mae_r", F.lit(0.0)).alias("mae_r"),
        "realized_r", (real - policy.cost_rate * 2).alias("realized_r_after_cost"), "last_bar", F.col("e").alias("entry_bar"),
    )


def events(rows: DataFrame, signals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The event log: signal_id, sequence, event_time, event_type, state_from, state_to, price, reason,
    zone_touched (of invalidated setups) and rule (of moved stops)."""
    x_at, way = F.col("x.at"), F.coalesce(F.col("x.way"), F.lit(""))
    i, here = F.col("i"), F.col("i") == F.col("x.at")
    here = F.coalesce(here, F.lit(False))
    open_row = F.coalesce(i >= F.col("e"), F.lit(False)) & F.coalesce(i <= x_at, F.lit(True))
    stopped = here & way.isin("HARD_STOP", "TRAILING_STOP")
    running = open_row & ~stopped
    p_at, decision = F.col("p.i"), F.col("p.decision")
    waiting = F.coalesce(i < p_at, F.lit(True)) & (F.col("e").isNull() | (i < F.col("e")))
    order = Window.partitionBy("signal_id").orderBy("i")
    previous = F.when(i == 1, "ARMED").otherwise(F.lag("waiting").over(order))
    prior_mfe = F.lag("mfe").over(order)
    stage = rows.withColumns({"_previous": previous, "_prior_mfe": prior_mfe})
    half = max(4, policy.max_holding // 2)
    h3_exit = here & (way == "H3_REACHED")
    leaves = here & way.isin("THESIS_INVALIDATED", "TIME_EXIT")
    before_h1 = F.col("h1").isNull() | (i < F.col("h1"))
    moved = F.coalesce(
        F.when(i == F.col("h1"), F.col("stop_after") > F.col("entry")).when(i > F.col("h1"), F.col("stop_after") > F.col("stop_before")),
        F.lit(False),
    )
    stalling = before_h1 & (
        (~leaves & (F.col("holding") == half) & (F.col("mfe") < policy.stall_r))
        | (leaves & (way == "TIME_EXIT") & (F.col("mfe") <= policy.stall_r) & ~(F.col("_prior_mfe") < policy.stall_r))
    )
    calm = before_h1 & ~leaves & ~((F.col("holding") >= half) & (F.col("mfe") < policy.stall_r))
    ready = F.coalesce((decision == "ENTRY_READY") & (i == p_at + 1) & F.col("gate").isNotNull(), F.lit(False))
    kinds = {"CANCELLED_STRUCTURE": "SETUP_INVALIDATED", "CANCELLED_DECAY": "SETUP_INVALIDATED", "EXPIRED": "ENTRY_TTL_EXPIRED",
             "CHASED": "SETUP_CHASED", "ENTRY_READY": "ENTRY_CONDITIONS_READY"}
    kind_of = F.lit(None).cast("string")
    for name, kind in kinds.items():
        kind_of = F.when(decision == name, kind).otherwise(kind_of)
    gate_kind = (
        F.when(F.col("gate") == "CHASED", "ENTRY_REJECTED_CHASE").when(F.col("gate") == "NO_ENTRY", "ENTRY_REJECTED_RR")
        .otherwise("ENTRY_FILLED_NEXT_OPEN")
    )

    def one(test: Column, kind: str | Column, state: str | Column, price: Column, at: Column | None = None,
            reason: Column | None = None, zone_touched: Column | None = None, rule: str | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        state = F.lit(state) if isinstance(state, str) else state
        body = F.struct((F.col("bar_ts") if at is None else at).alias("event_time"), kind.alias("event_type"),
                        state.alias("state_to"), price.cast("double").alias("price"),
                        (F.lit(None) if reason is None else reason).cast("array<string>").alias("reason"),
                        (F.lit(None) if zone_touched is None else zone_touched).cast("boolean").alias("zone_touched"),
                        F.lit(rule).cast("string").alias("rule"))
        return F.when(F.coalesce(test, F.lit(False)), body)

    def told(*text: str) -> Column:
        return F.array(*[F.lit(t) for t in text])

    none = F.lit(None).cast("double")
    healthy = F.lit(None).cast("array<string>")
    for health, text in HEALTH_REASONS.items():
        healthy = F.when(F.col("health") == health, told(*text)).otherwise(healthy)
    leaving = F.lit(None).cast("array<string>")
    for name, text in EXIT_REASONS.items():
        leaving = F.when(way == name, told(text)).otherwise(leaving)
    cancelled = decision.isin("CANCELLED_STRUCTURE", "CANCELLED_DECAY")
    log = [
        one(i == 1, "STATE_REVIEW", "ARMED", none, reason=told(FIRST_BAR_REASON)),
        one(ready, gate_kind, F.col("gate"), F.col("open"), reason=F.when(F.col("gate") == "NO_ENTRY", told(RISK_REWARD_REASON))),
        one(waiting & (F.col("decision").isNull()) & (F.col("_previous") != F.col("waiting")), "SETUP_REVIEWED", F.col("waiting"), none, reason=healthy),
        one(i == p_at, kind_of, decision, F.col("close"), reason=F.when(cancelled | (decision == "ENTRY_READY"), healthy),
            zone_touched=F.when(cancelled, F.col("touched"))),
        one(stopped, way, way, F.when(way == "HARD_STOP", F.col("stop")).otherwise(F.col("stop_before"))),
        one(running & (i == F.col("h1")), "H1_TOUCHED", "H1_REACHED", F.col("t1")),
        one(running & (i == F.col("h1")), "STOP_TIGHTENED", "PROGRESSING", F.col("entry"), rule=BREAKEVEN_RULE),
        one(running & (i == F.col("h2")), "H2_TOUCHED", "H2_REACHED", F.col("t2")),
        one(running & (i == F.col("h3")), "H3_TOUCHED", "H3_REACHED", F.col("t3")),
        one(running & ~h3_exit & moved, "STOP_TIGHTENED", "PROGRESSING", F.col("stop_after"), rule=TRAIL_RULE),
        one(running & stalling, "TRADE_STALLED", "STALLED", none),
        one(running & calm, "POSITION_ACTIVE", "ACTIVE", none),
        one(leaves & F.col("next_open").isNotNull(), "EXIT_FILLED_NEXT_OPEN", way, F.col("next_open"), F.col("next_ts"), reason=leaving),
    ]
    listed = stage.select("signal_id", "i", F.posexplode(F.array_compact(F.array(*log))).alias("_k", "_e"))
    later = listed.select("signal_id", "i", "_k", "_e.*")
    start = signals
    for level in LEVELS:
        start = start.filter(F.col(level).isNotNull())
    first = start.select(
        "signal_id", F.lit(0).alias("i"), F.lit(0).alias("_k"), F.col("ts").alias("event_time"),
        F.lit("SIGNAL_DETECTED").alias("event_type"), F.lit("DETECTED").alias("state_to"), none.alias("price"),
        F.lit(None).cast("array<string>").alias("reason"), F.lit(None).cast("boolean").alias("zone_touched"), F.lit(None).cast("string").alias("rule"),
    )
    every = Window.partitionBy("signal_id").orderBy("i", "_k")
    return first.unionByName(later).select(
        "signal_id", F.row_number().over(every).alias("sequence"), "event_time", "event_type",
        F.lag("state_to", 1, "DETECTED").over(every).alias("state_from"), "state_to", "price",
        "reason", "zone_touched", "rule",
    )


def evaluate(signals: DataFrame, bars: DataFrame, now: Column, policy: Policy = Policy(), data_usable: bool = True) -> tuple[DataFrame, DataFrame]:
    """(setups, events) of all signals with a complete plan, including those without a later bar yet.

    A signal counts from the completion of its own bar on; one whose bar is still open is left out.
    """
    from barloom.staging import hold

    signals = completed(signals, now)
    rows = hold(setup_bars(signals, bars, now, policy, data_usable))
    log = hold(events(rows, signals, policy))
    final = log.groupBy("signal_id").agg(
        F.max_by("state_to", "sequence").alias("state"), F.count(F.lit(1)).alias("events"),
        F.min(F.when(F.col("event_type") == "ENTRY_FILLED_NEXT_OPEN", F.col("sequence") - 1)).alias("bars_to_entry"),
        F.max_by("event_type", "sequence").alias("last_event"), F.max("event_time").alias("last_event_time"),
        F.max_by(F.coalesce("reason", F.array("event_type")), "sequence").alias("action_reason"),
    )
    ends = completed(bars, now).groupBy("symbol").agg(F.max("bar_no").alias("_end"))
    counts = signals.join(ends, "symbol").select("signal_id", (F.col("_end") - F.col("bar_no")).alias("_completed"))
    action = F.lit("BEKLE")
    for state, name in ACTIONS.items():
        action = F.when(F.col("state") == state, name).otherwise(action)
    own = signals.select("signal_id", F.col("symbol").alias("_symbol"), F.col("ts").alias("_time"))
    table = final.join(setups(rows, policy=policy), "signal_id", "left").join(counts, "signal_id", "left").join(own, "signal_id")
    table = table.withColumns({"symbol": F.coalesce("symbol", "_symbol"), "signal_time": F.coalesce("signal_time", "_time")}).drop("_symbol", "_time")
    in_trade = F.when(F.col("entry_bar").isNotNull(), F.col("_completed") - F.col("entry_bar") + 1).otherwise(0)
    return table.withColumns({
        "bars_in_trade": in_trade.cast("long"), "action": action,
        "mfe_r": F.coalesce("mfe_r", F.lit(0.0)), "mae_r": F.coalesce("mae_r", F.lit(0.0)),
        "health": F.coalesce("health", F.lit(HEALTH_GOOD)), "highest_target": F.coalesce("highest_target", F.lit(0)),
    }).drop("_completed", "entry_bar"), log


def new_events(log: DataFrame, stored: DataFrame, stored_setups: DataFrame | None = None) -> DataFrame:
    """Events not stored yet; setups that are already terminal are left alone."""
    if stored_setups is not None:
        done = stored_setups.filter(F.col("outcome").isNotNull()).select("signal_id")
        log = log.join(done, "signal_id", "left_anti")
    return log.join(stored.select("signal_id", "sequence"), ["signal_id", "sequence"], "left_anti")


def plan_versions(signals: DataFrame, log: DataFrame) -> DataFrame:
    """The plans of every setup with the interval of events in which each holds.

    Version 1 is the signal's plan; each stop that the log moves gives the next version, with its rule
    as the reason.  A version holds for the events from ``from_sequence`` up to, but not with,
    ``to_sequence`` (null: still in force).
    """
    whole = signals
    for level in LEVELS:
        whole = whole.filter(F.col(level).isNotNull())
    plans = whole.select("signal_id", F.col("ts").alias("signal_time"), *LEVELS)
    first = plans.select("signal_id", F.lit(1).alias("from_sequence"), F.col("signal_time").alias("effective_at"), F.lit(SIGNAL_PLAN).alias("reason"), F.col("stop").alias("_stop"))
    moved = log.filter(F.col("event_type") == "STOP_TIGHTENED").select(
        "signal_id", F.col("sequence").alias("from_sequence"), F.col("event_time").alias("effective_at"), F.col("rule").alias("reason"), F.col("price").alias("_stop"))
    order = Window.partitionBy("signal_id").orderBy("from_sequence")
    versions = first.unionByName(moved).withColumns({
        "version": F.row_number().over(order), "to_sequence": F.lead("from_sequence").over(order),
    })
    return versions.join(plans, "signal_id").select(
        "signal_id", "version", "from_sequence", "to_sequence", "effective_at", "reason",
        "zone_low", "zone_high", F.col("_stop").alias("stop"), "t1", "t2", "t3",
    )


def with_plan_in_force(log: DataFrame, versions: DataFrame) -> DataFrame:
    """Each event with the version, and its stop, whose interval holds it.

    The interval join is an as-of scan over sequence numbers, so no event meets versions that do not
    hold it.  The event that moves the stop belongs to the version it makes.
    """
    held = versions.select("signal_id", F.col("from_sequence").alias("sequence"), F.col("version").alias("plan_version"), F.col("stop").alias("plan_stop"))
    return as_of(log, held, ["signal_id"], F.floor(F.col("sequence") / 1024), ["plan_version", "plan_stop"], ts="sequence")


def newest_setup(setups_: DataFrame, log: DataFrame) -> DataFrame:
    """The events of the newest setup of each symbol, one row for each."""
    newest = setups_.groupBy("symbol").agg(F.max_by("signal_id", F.struct("signal_time", "signal_id")).alias("signal_id"))
    return log.join(newest, "signal_id")


def analytics(setups_: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, outcome histogram); medians are exact and spread over slices."""
    from barloom.quantiles import exact_quantiles

    h1 = log.filter(F.col("event_type") == "H1_TOUCHED").groupBy("signal_id").agg(F.min("event_time").alias("_h1"))
    rows = setups_.join(h1, "signal_id", "left").withColumns({
        "_entry_min": (F.unix_micros("entry_time") - F.unix_micros("signal_time")) / 60e6,
        "_h1_min": (F.unix_micros("_h1") - F.unix_micros("entry_time")) / 60e6,
        "_r": F.when(F.col("outcome").isNotNull(), F.col("realized_r_after_cost")),
    })
    totals = rows.agg(
        F.count(F.lit(1)).alias("planned"), F.count("entry_time").alias("entry_activated"),
        F.avg(F.col("entry_time").isNotNull().cast("int")).alias("activation_rate"), F.avg("_r").alias("expected_r"),
    )
    for value, name, mode in (("_r", "median_realized_r", "upper"), ("_entry_min", "median_minutes_to_entry", "linear"),
                              ("_h1_min", "median_minutes_to_h1", "linear")):
        one = exact_quantiles(rows, [], value, {name: (0.5, mode)})
        totals = totals.join(F.broadcast(one), F.lit(True), "left")  # one row each
    histogram = setups_.filter(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count(F.lit(1)).alias("setups"))
    return totals, histogram
