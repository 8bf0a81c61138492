"""Accepted-only cooldown: a signal is compared with the last accepted one, not with the last one.

After an accepted signal the next accepted one is fixed: the first later signal that is old enough or
scores enough more, its *successor*.  The accepted signals of a key are what its first signal reaches by
successors.  Signals are numbered in their key and cut into blocks.  Inside a block each signal's walk is
followed to the last signal it reaches there, its *end*; where an end's successor lies in a later block
is found through summary levels of blocks.  The ends that the first signal reaches are found by pointer
doubling over that table, in rounds of equi-joins that grow with the logarithm of a key's blocks.  With
the end that enters each block known, blocks are judged by themselves.  No task and no array holds more
than one block of a key, however dense its signals are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.series import running
from barloom.session import checkpoint_dir
from barloom.staging import hold

DAY = 86400
BLOCK = 1024
FAN = 64
# Points a new score needs to be an upgrade inside the cooldown.
UPGRADE_POINTS = 5
_NEVER = 1 << 62


def number_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "_pos") -> DataFrame:
    """Dense 0-based position in the key; rows are sorted in slices, and slices only counted."""
    keys = list(keys)
    sliced = rows.withColumn("_slice", slice_by)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    before = counts.select(*keys, "_slice", (F.sum("_rows").over(over) - F.col("_rows")).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    placed = sliced.withColumn("_at", F.row_number().over(inside) - 1).join(before, [*keys, "_slice"])
    return placed.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_slice", "_at", "_before")


def _enough(score: int, points: int) -> int:
    """The least score that is an upgrade; out of reach for a missing one."""
    return _NEVER if score == -_NEVER else score + points


def successors(t: np.ndarray, score: np.ndarray, reach: int, points: int, inclusive: bool) -> np.ndarray:
    """Index of each row's successor among the rows of a block; their number where it lies behind the block."""
    n = len(t)
    aged = np.searchsorted(t, t + reach, "right" if inclusive else "left")
    out = np.maximum(aged, np.arange(1, n + 1)) if n else aged
    better: list[int] = []  # places to the right, the nearest last; scores fall towards the end
    heights: list[int] = []  # their negated scores, rising towards the end
    for i in range(n - 1, -1, -1):
        own = int(score[i])
        k = bisect_left(heights, 1 - _enough(own, points)) - 1  # the last place whose score is enough
        if k >= 0 and better[k] < out[i]:
            out[i] = better[k]
        while heights and -heights[-1] <= own:
            heights.pop()
            better.pop()
        better.append(i)
        heights.append(-own)
    return out


def _numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(table.column("_pos").to_numpy())
    t, score, opened = (table.column(c).to_numpy()[order] for c in ("_t", "_score", "_open"))
    return order, t, score, opened.astype(bool)


def _ends(reach: int, points: int, inclusive: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds ``_end``, the position of the last row that each open row's walk reaches in the block."""

    def run(table: pa.Table) -> pa.Table:
        order, t, score, opened = _numbers(table)
        pos = table.column("_pos").to_numpy()[order]
        at = np.flatnonzero(opened)
        after = successors(t[at], score[at], reach, points, inclusive)
        end = np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            if after[i] < len(at):
                end[i] = end[after[i]]
        out = np.full(len(pos), -1, np.int64)
        out[order[at]] = pos[at[end]] if len(at) else out[:0]
        return table.append_column("_end", pa.array(out))

    return run


def _judge(reach: int, points: int, inclusive: bool) -> Callable[[pa.Table], pa.Table]:
    """Decisions of a block's rows, given time and score of the accepted row that enters it (``_in_t``, ``_in_score``)."""

    def run(table: pa.Table) -> pa.Table:
        order, t, score, opened = _numbers(table)
        n = len(t)
        in_t, in_score = (table.column(c)[0].as_py() for c in ("_in_t", "_in_score"))
        at = np.flatnonzero(opened)
        after = successors(t[at], score[at], reach, points, inclusive)
        taken = np.zeros(n, bool)
        if len(at):
            if in_t is None:
                i = 0
            else:
                aged = t[at] - in_t > reach if inclusive else t[at] - in_t >= reach
                hits = np.flatnonzero(aged | (score[at] >= _enough(in_score, points)))
                i = int(hits[0]) if len(hits) else len(at)
            while i < len(at):
                taken[at[i]] = True
                i = int(after[i])
        last = np.maximum.accumulate(np.where(taken, np.arange(n), -1))
        before = np.concatenate([[-1], last[:-1]])
        known = (before >= 0) | (in_t is not None)
        a_t = np.where(before >= 0, t[before], in_t if in_t is not None else 0)
        a_score = np.where(before >= 0, score[before], in_score if in_score is not None else 0)
        age = t - a_t
        fresh = ~known | (age > reach if inclusive else age >= reach)
        better = known & (a_score != -_NEVER) & (score >= a_score + points)
        text = np.select([~fresh & ~better, ~opened, fresh], ["COOLDOWN", "BLOCKED", "CREATED"], "UPGRADED").astype(object)
        decision = np.empty(n, object)
        decision[order] = text
        return table.drop_columns(["_in_t", "_in_score"]).append_column("decision", pa.array(decision, pa.string()))

    return run


def _later_blocks(ends: DataFrame, blocks: DataFrame, keys: list[str], reached: Column, most: int) -> DataFrame:
    """For each end the first later block that can hold its successor, by summary levels of ``FAN`` blocks each.

    ``most`` is the last block's number.
    """
    levels = [blocks]
    while most >= FAN:
        most //= FAN
        above = levels[-1].withColumn("_block", F.floor(F.col("_block") / FAN))
        levels.append(above.groupBy(*keys, "_block").agg(F.max("_last_t").alias("_last_t"), F.max("_most").alias("_most")))

    def first(some: DataFrame, level: DataFrame) -> DataFrame:
        return some.join(level, [*keys, "_block"]).filter(reached).groupBy(*keys, "_end").agg(F.min("_block").alias("_block"))

    plain = ends.select(*keys, "_end", "_t", "_score")
    todo = plain.join(ends.select(*keys, "_end", (F.col("_block") + 1).alias("_from")), [*keys, "_end"])
    found = []
    for level in levels:  # up: the rest of the blocks under the same parent
        stop = (F.floor(F.col("_from") / FAN) + 1) * FAN - 1
        here = first(todo.withColumn("_block", F.explode(F.sequence("_from", stop))), level)
        found.append(here)
        todo = todo.join(here, [*keys, "_end"], "left_anti").withColumn("_from", F.floor(F.col("_from") / FAN) + 1)
    for k in range(len(levels) - 1, 0, -1):  # down: the children of what was found
        low = F.col("_block") * FAN
        inside = plain.join(found[k], [*keys, "_end"]).withColumn("_block", F.explode(F.sequence(low, low + FAN - 1)))
        found[k - 1] = found[k - 1].unionByName(first(inside, levels[k - 1]))
    return found[0]


def _steps(
    opened: DataFrame, ends: DataFrame, blocks: DataFrame, keys: list[str], reach: int, points: int, inclusive: bool, most: int,
) -> DataFrame:
    """From each end to the end of its successor's walk: keys, _end, _next."""
    aged = F.col("_t") + reach
    enough = F.when(F.col("_score") == -_NEVER, F.lit(_NEVER)).otherwise(F.col("_score") + points)

    def meets(t: str, score: str) -> Column:
        return ((F.col(t) > aged) if inclusive else (F.col(t) >= aged)) | (F.col(score) >= enough)

    later = _later_blocks(ends, blocks, keys, meets("_last_t", "_most"), most)
    side = opened.select(*keys, "_block", F.col("_pos").alias("_at"), F.col("_t").alias("_at_t"), F.col("_score").alias("_at_score"), F.col("_end").alias("_at_end"))
    found = ends.drop("_block").join(later, [*keys, "_end"]).join(side, [*keys, "_block"]).filter(meets("_at_t", "_at_score"))
    return found.groupBy(*keys, "_end").agg(F.min_by("_at_end", "_at").alias("_next"))


def _reached(start: DataFrame, step: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The nodes that ``start`` reaches by ``step`` (keys, _end, _next), by pointer doubling.

    A step leads to a later block, so as many rounds as the last block's number has bits reach all.
    """
    reach, jump = start, step.checkpoint()
    rounds = most.bit_length()
    for k in range(rounds):
        new = reach.join(jump, [*keys, "_end"]).select(*keys, F.col("_next").alias("_end"))
        reach = reach.unionByName(new).distinct()
        if k + 1 < rounds:
            twice = jump.select(*keys, F.col("_end").alias("_first"), F.col("_next").alias("_end")).join(jump, [*keys, "_end"])
            jump = twice.select(*keys, F.col("_first").alias("_end"), "_next").checkpoint()
        if k % 3 == 2:
            reach = reach.checkpoint()
    return reach


def decide(
    signals: DataFrame,
    keys: Sequence[str],
    cooldown_seconds: int,
    upgrade_points: int = UPGRADE_POINTS,
    inclusive: bool = True,
    ts: str = "ts",
    score: str = "score",
    allowed: str | None = None,
    order: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``decision``: CREATED, UPGRADED, COOLDOWN, DUPLICATE, or BLOCKED for rows ``allowed`` rules out.

    Rows of a key are ordered by time and ``order`` (a tie breaker).  Of rows with the same key, time
    and tie the one of the highest score is decided on, the others are DUPLICATE.
    Only accepted rows (CREATED, UPGRADED) become the row later ones are compared with.
    ``inclusive`` says whether a row exactly ``cooldown`` old still counts.  A missing score is no
    upgrade and is upgraded by none.
    """
    spark = signals.sparkSession
    checkpoint_dir(spark)
    keys = list(keys)
    reach = cooldown_seconds * 1_000_000
    t = F.unix_micros(ts)
    tie = F.col(order).cast("long") if order else F.lit(0).cast("long")
    open_ = F.coalesce(F.col(allowed), F.lit(False)) if allowed else F.lit(True)
    same = Window.partitionBy(*keys, "_t", "_n").orderBy(F.col(score).desc_nulls_last(), open_.desc())
    marked = hold(signals.withColumns({"_t": t, "_n": tie}).withColumn("_copy", F.row_number().over(same)))
    rows = marked.filter("_copy = 1").select(*keys, "_t", "_n", F.coalesce(F.col(score).cast("long"), F.lit(-_NEVER)).alias("_score"), open_.alias("_open"))
    rows = number_rows(rows, keys, ["_t", "_n"], F.floor(F.col("_t") / F.lit(DAY * 1_000_000)))
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / block))
    walked = hold(rows.groupBy(*keys, "_block").applyInArrow(
        _ends(reach, upgrade_points, inclusive), T.StructType([*rows.schema.fields, T.StructField("_end", T.LongType())])))

    opened = walked.filter("_open")
    blocks = opened.groupBy(*keys, "_block").agg(F.max("_t").alias("_last_t"), F.max("_score").alias("_most"))
    ends = opened.filter("_end = _pos").select(*keys, "_block", "_end", "_t", "_score")
    start = opened.groupBy(*keys).agg(F.min_by("_end", "_pos").alias("_end"))
    most = int(blocks.agg(F.max("_block")).first()[0] or 0)
    reached = _reached(start, _steps(opened, ends, blocks, keys, reach, upgrade_points, inclusive, most), keys, most) if most else start

    # what enters a block is the last reached end of an earlier one
    entering = reached.join(ends, [*keys, "_end"]).select(*keys, (F.col("_block") + 1).alias("_block"), F.struct("_t", "_score").alias("_in"))
    table = walked.select(*keys, "_block").distinct().join(entering, [*keys, "_block"], "left")
    table = running(table, keys, ["_block"], F.floor(F.col("_block") / block), {"_enter": ("_in", "last")})
    table = table.select(*keys, "_block", F.col("_enter._t").alias("_in_t"), F.col("_enter._score").alias("_in_score"))
    judged = walked.drop("_end").join(table, [*keys, "_block"]).groupBy(*keys, "_block").applyInArrow(
        _judge(reach, upgrade_points, inclusive), T.StructType([*rows.schema.fields, T.StructField("decision", T.StringType())]))
    verdicts = judged.select(*keys, "_t", "_n", "decision")
    decided = marked.join(verdicts, [*keys, "_t", "_n"])
    decision = F.when(F.col("_copy") == 1, F.col("decision")).otherwise("DUPLICATE")
    return decided.withColumn("decision", decision).drop("_t", "_n", "_copy")


def signal_decisions(signals: DataFrame, cooldown_minutes: int = 60, upgrade_points: int = UPGRADE_POINTS) -> DataFrame:
    """SIGNAL_CREATED, SIGNAL_UPGRADED, REJECTED_COOLDOWN or REJECTED_DUPLICATE per symbol and timeframe."""
    names = {
        "CREATED": "SIGNAL_CREATED", "UPGRADED": "SIGNAL_UPGRADED", "COOLDOWN": "REJECTED_COOLDOWN", "DUPLICATE": "REJECTED_DUPLICATE",
    }
    out = decide(signals, ["symbol", "timeframe"], cooldown_minutes * 60, upgrade_points)
    named = F.lit(None).cast("string")
    for short, name in names.items():
        named = F.when(F.col("decision") == short, name).otherwise(named)
    return out.withColumn("decision", named)


def alert_decisions(alerts: DataFrame, cooldown_minutes: int = 60, upgrade_points: int = UPGRADE_POINTS) -> DataFrame:
    """Status and reason of every alert: duplicates by key, then cooldown after the last sent one.

    Reads symbol, sent_at (dispatch time), ts, score, classification, ``reason`` (null when
    eligible) and ``seq``, the arrival number.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+00:00")
    keyed = alerts.withColumn("dedup_key", F.concat_ws(":", "classification", "symbol", stamp, F.col("score").cast("string")))
    first = keyed.groupBy("dedup_key").agg(F.min("seq").alias("_first"))
    marked = keyed.join(first, "dedup_key").withColumn("_copy", F.col("seq") > F.col("_first")).drop("_first")
    open_ = marked.filter(~F.col("_copy")).withColumn("_ok", F.col("reason").isNull())
    judged = decide(open_, ["symbol"], cooldown_minutes * 60, upgrade_points, inclusive=False, ts="sent_at", allowed="_ok", order="seq")
    cold = F.col("decision") == "COOLDOWN"
    sent = F.col("decision").isin("CREATED", "UPGRADED")
    judged = judged.withColumns({
        "status": F.when(sent, "SENT").otherwise("SUPPRESSED"),
        "reason": F.when(cold, "ALERT_SUPPRESSED_COOLDOWN").otherwise(F.col("reason")),
    }).drop("_ok", "_copy", "decision")
    copies = marked.filter("_copy").withColumns({
        "status": F.lit("DUPLICATE"), "reason": F.lit("ALERT_SUPPRESSED_DUPLICATE")}).drop("_copy")
    return judged.unionByName(copies)
