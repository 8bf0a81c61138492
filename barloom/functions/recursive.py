"""Recursive (exponential) means on blocked series, without any per-symbol fold.

With keep = 1 - alpha, a value inside a block is a running sum of weight * x * keep**-i scaled by
keep**i, plus keep**(i+1) times the state carried into the block.  The state at a block's start is
a short weighted sum over the preceding block summaries, because keep**(rows per block) vanishes
after a few blocks.  All recursions share one window; the carry works on one row per block.

States are carried to the second halo row (the first one only serves one-row differences), so
copied rows are exact as well and later look-backs (slopes, comparisons with earlier values) work
across block borders.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from barloom.series import Series
from barloom.staging import hold

# Powers of ``keep`` over one block must stay far from the range of a double.
_LARGEST_EXPONENT = 600.0
# Weights below this cannot change a double unless values differ by a factor of 2**60 or more.
_NEGLIGIBLE = 2.0**-112


@dataclass(frozen=True)
class Mean:
    """A recursive mean: seeded with the value at row ``start``, null before ``periods`` values."""

    name: str
    column: str
    alpha: float
    periods: int
    start: int = 0

    @property
    def keep(self) -> float:
        return 1 - self.alpha


def span_mean(name: str, column: str, span: int, warm: bool = True) -> Mean:
    return Mean(name, column, 2 / (span + 1), span if warm else 1)


def wilder_mean(name: str, column: str, period: int, start: int = 0) -> Mean:
    return Mean(name, column, 1 / period, period, start)


def _num(value: float) -> str:
    """A double literal in SQL text."""
    return f"{value!r}D" if "e" not in repr(value) else f"{value!r}"


def _pow(base: float, exponent: str) -> str:
    return f"power({_num(base)}, {exponent})"


def _seeded(start: int, alpha: float, value: str) -> str:
    return (
        f"(CASE WHEN bar_no = {start} THEN {value} WHEN bar_no > {start} "
        f"THEN {_num(alpha)} * {value} ELSE 0D END)"
    )


def add_means(
    s: Series,
    means: Sequence[Mean],
    totals: Sequence[str] = (),
    macd: tuple[str, str, int] | None = None,
) -> Series:
    """Add one column per mean, a running total per column in ``totals`` (named ``cum_<column>``),
    and, for ``macd=(fast, slow, signal_span)`` naming two of the means, ``macd``,
    ``macd_signal`` and ``macd_histogram``.

    Inputs must be non-null from each mean's start row on; quality gates run first.
    """
    keys = ", ".join(s.keys)
    lead = s.halo - 1
    begin = f"greatest(_block * {s.size} - {lead}, 0)"
    i = f"greatest(bar_no - {begin}, 0)"
    upto = f"OVER (PARTITION BY {keys}, _block ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    blocks = f"OVER (PARTITION BY {keys} ORDER BY _block"

    def running_mean(start: int, alpha: float, value: str) -> str:
        keep = 1 - alpha
        if keep <= 0 or -math.log(keep) * (s.size + lead + 1) > _LARGEST_EXPONENT:
            return short_mean(start, alpha, value)
        term = f"{_seeded(start, alpha, value)} * {_pow(1 - alpha, f'-{i}')}"
        return f"sum(CASE WHEN bar_no >= {begin} THEN {term} ELSE 0D END) {upto} * {_pow(1 - alpha, i)}"

    def short_mean(start: int, alpha: float, value: str) -> str:
        """A mean so short that only few rows still weigh: these, each times its own weight."""
        keep = 1 - alpha
        reach = 1 if keep <= 0 else math.ceil(math.log(_NEGLIGIBLE) / math.log(keep))
        frame_ = f"OVER (PARTITION BY {keys}, _block ORDER BY bar_no ROWS BETWEEN {reach - 1} PRECEDING AND CURRENT ROW)"
        terms = f"reverse(collect_list(CASE WHEN bar_no >= {begin} THEN {_seeded(start, alpha, value)} ELSE 0D END) {frame_})"
        return f"aggregate(transform({terms}, (x, k) -> x * {_pow(keep, 'k')}), 0D, (total, x) -> total + x)"

    def chain(column: str, keep: float) -> str:
        """State at each block's end from the block sums of this and the preceding blocks."""
        decay = keep**s.size
        parts, back, weight = [column], 1, decay
        while weight > _NEGLIGIBLE:
            parts.append(f"coalesce(lag({column}, {back}) {blocks}), 0D) * {_num(weight)}")
            back, weight = back + 1, weight * decay
        return " + ".join(parts)

    names = [f"_l_{m.name}" for m in means] + [f"_s_{c}" for c in totals]
    frame = s.frame.selectExpr(
        "*",
        *[f"{running_mean(m.start, m.alpha, f'coalesce({m.column}, 0D)')} AS _l_{m.name}" for m in means],
        *[f"sum(CASE WHEN bar_no >= {begin} THEN {c} ELSE 0D END) {upto} AS _s_{c}" for c in totals],
    )
    if macd:
        by = {m.name: m for m in means}
        fast, slow, span = by[macd[0]], by[macd[1]], macd[2]
        alpha = 2 / (span + 1)
        keep, seed = 1 - alpha, slow.periods - 1
        if len({fast.keep, slow.keep, keep}) < 3:
            raise ValueError("fast, slow and signal spans must differ")
        line = f"(_l_{fast.name} - _l_{slow.name})"
        frame = frame.selectExpr("*", f"{running_mean(seed, alpha, line)} AS _l_signal")
        names.append("_l_signal")

        def spill(m: Mean, steps: str | int) -> str:
            """How much of a carried mean enters the signal after ``steps`` rows."""
            factor = alpha * m.keep / (m.keep - keep)
            if isinstance(steps, int):
                return _num(factor * (m.keep**steps - keep**steps))
            return f"({_num(factor)} * ({_pow(m.keep, steps)} - {_pow(keep, steps)}))"

    # The summary and the finish both read the local values; compute them once.
    frame = hold(frame)
    edge = f"bar_no = (_block + 1) * {s.size} - {lead + 1}"
    summary = frame.filter(edge).selectExpr(
        *s.keys, "_block", *names,
        *[f"{chain(f'_l_{m.name}', m.keep)} AS _e_{m.name}" for m in means],
        *[f"sum(_s_{c}) {blocks} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _e_s_{c}" for c in totals],
    )
    carried = [f"_e_{m.name}" for m in means] + [f"_e_s_{c}" for c in totals]
    if macd:
        entered = [
            f"{sign} coalesce(lag(_e_{m.name}) {blocks}), 0D) * {spill(m, s.size)}"
            for sign, m in (("+", fast), ("-", slow))
        ]
        summary = summary.selectExpr("*", f"_l_signal {' '.join(entered)} AS _t_signal")
        summary = summary.selectExpr("*", f"{chain('_t_signal', keep)} AS _e_signal")
        carried.append("_e_signal")
    carry = summary.selectExpr(*s.keys, "_block + 1 AS _block", *[f"{c} AS {c}" for c in carried])
    joined = frame.join(carry, [*s.keys, "_block"], "left")

    def state(name: str) -> str:
        return f"coalesce(_e_{name}, 0D)"

    step = f"({i} + 1)"
    kept = [c for c in s.frame.columns]
    full = {m.name: f"(_l_{m.name} + {_pow(m.keep, step)} * {state(m.name)})" for m in means}
    out = [
        f"CASE WHEN bar_no >= {m.start + m.periods - 1} THEN {full[m.name]} END AS {m.name}" for m in means
    ] + [f"_s_{c} + {state(f's_{c}')} AS cum_{c}" for c in totals]
    if macd:
        signal = (
            f"_l_signal + {_pow(keep, step)} * {state('signal')} + {spill(fast, step)} * {state(fast.name)}"
            f" - {spill(slow, step)} * {state(slow.name)}"
        )
        line = f"{full[fast.name]} - {full[slow.name]}"
        ready = seed + span - 1
        out += [
            f"CASE WHEN bar_no >= {seed} THEN {line} END AS macd",
            f"CASE WHEN bar_no >= {ready} THEN {signal} END AS macd_signal",
            f"CASE WHEN bar_no >= {ready} THEN {line} - ({signal}) END AS macd_histogram",
        ]
    return Series(joined.selectExpr(*kept, *out), s.keys, s.halo, s.size)
