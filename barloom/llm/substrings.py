"""Removal of repeated word strings by recompression.

A text is a string of word names.  In rounds, neighbouring symbols get a common name: first runs (a
word that stands twice), then pairs whose left symbol is of the left half and whose right symbol is of
the right half of all names.  A name is a hash of what it stands for, so all tasks of all rounds agree
on it without a dictionary, and equal strings have equal symbols inside, up to ``CONTEXT`` words at
either end.  In each window the least of those inner symbols reveals whether it may repeat: symbol and
context are its core.  Spans and single windows then verify (``repeats``).

A round joins at most two symbols, and a longer run keeps its single symbols, so no symbol is longer
than ``LONGEST`` words and what lies further than ``CONTEXT`` words away never matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.repeats import Anchors, repeated
from barloom.llm.textarrays import Spans, covered, mix, window_starts, word_names, words

WIDTH = 35
PAIR_ROUNDS = 2
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def reach(rounds: int) -> tuple[int, int]:
    """CONTEXT and LONGEST after the run round and ``rounds`` pair rounds, in words."""
    context = longest = 2
    for _ in range(rounds):
        context, longest = context + longest, 2 * longest
    return context, longest


CONTEXT, LONGEST = reach(PAIR_ROUNDS)


def recompress(names: np.ndarray, before: np.ndarray, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts: their names and first words; the last entry of the places is the number of words."""
    n = len(names)
    first = np.arange(n + 1)
    text_start = np.zeros(n + 1, bool)
    text_start[before] = True
    for k in range(rounds + 1):
        if len(names) < 2:
            break
        apart = text_start[first[1:-1]]  # the boundary is the end of a text
        same = (names[1:] == names[:-1]) & ~apart
        if k == 0:
            alone_left = np.ones(len(same), bool)
            alone_left[1:] = ~same[:-1]
            alone_right = np.ones(len(same), bool)
            alone_right[:-1] = ~same[1:]
            join = same & alone_left & alone_right  # a run of exactly two
        else:
            half = (mix(names ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(bool)
            join = ~half[:-1] & half[1:] & ~same & ~apart
        joined = mix(names[:-1] * np.uint64(0xD6E8FEB86659FD93) + mix(names[1:] + np.uint64(k + 1)))
        new = names.copy()
        new[:-1][join] = joined[join]
        keep = np.ones(len(names), bool)
        keep[1:] = ~join
        names, first = new[keep], np.append(first[:-1][keep], n)
    return names, first


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least value in each [low, high), the leftmost of equals."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)  # equal values rank by place
    levels, width = [rank], 1
    most = int((high - low).max())
    while 2 * width <= most:
        top = levels[-1].copy()
        np.minimum(levels[-1][:n - width], levels[-1][width:], out=top[:n - width])
        levels.append(top)
        width *= 2
    level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    best = np.empty(len(low), np.int64)
    for k, table in enumerate(levels):
        at = level == k
        best[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
    return order[best]


def word_anchors(width: int = WIDTH) -> Callable[[np.ndarray, np.ndarray], Anchors]:
    rounds = PAIR_ROUNDS
    while rounds and width < 2 * reach(rounds)[0] + 2 * reach(rounds)[1]:
        rounds -= 1
    context, longest = reach(rounds)
    if width < 2 * context + 2 * longest:
        raise ValueError(f"windows need {2 * context + 2 * longest} words or more")

    def run(data: np.ndarray, offsets: np.ndarray) -> Anchors:
        begin, end, before = words(data, offsets)
        names = [word_names(data, begin, end, k) for k in (0, 1)]
        named = Spans.of_names(*names).names
        starts = window_starts(before, width)
        if not len(starts):
            return Anchors(starts, starts, starts.astype(np.uint64), np.zeros((0, 2), np.uint64), lambda s: named(s, s + width))
        symbols, first = recompress(names[0], before, rounds)
        low = np.searchsorted(first, starts + context)  # symbols that lie wholly in the inner part
        high = np.searchsorted(first, starts + width - context, "right") - 1
        chosen = _range_least(symbols, low, high)
        cut = np.ones(len(starts), bool)
        cut[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(cut)
        last = np.append(at[1:], len(starts)) - 1
        a, b, c = starts[at], starts[last], chosen[at]
        core = named(first[c] - context, first[c + 1] + context)[:, 0]
        return Anchors(a, b, core, named(a, b + width), lambda s: named(s, s + width))

    return run


def _finish(width: int):
    def run(ids: list, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        begin, end, before = words(data, offsets)
        gone = covered(starts, width, len(begin))
        raw = data.tobytes()
        kept, removed, digests = [], [], []
        touched = set(np.unique(np.searchsorted(before, starts, "right") - 1).tolist())
        for k, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
            left = raw[offsets[k]:offsets[k + 1]]
            removed.append(0)
            if k in touched:
                own = np.concatenate([[True], gone[a:b], [True]])
                on = np.flatnonzero(own[:-1] & ~own[1:]) + a  # first and, exclusive, last word of each run that stays
                off = np.flatnonzero(~own[:-1] & own[1:]) + a
                left = b" ".join([raw[x:y] for x, y in zip(begin[on].tolist(), end[off - 1].tolist())])
                removed[-1] = int(gone[a:b].sum())
            kept.append(left.decode())
            digests.append(hashlib.sha256(b" ".join(left.split())).hexdigest())
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(np.diff(before)), pa.array(removed, pa.int64()),
            pa.array(digests, pa.string()), pa.array(kept, pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def drop_repeated_words(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` without the words that lie in a window of ``width`` words that also starts elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Returns doc_id, n_words, n_removed, kept_sha256 (of the
    other words, joined by one space), ``kept`` and the columns named in ``carry``.  ``kept`` is the
    text itself where nothing goes, else its runs of other words with their white space, joined by one
    space.  Windows never cross documents and are judged on
    the input.  Null texts have no words, repeated rows and null ids are documents of their own, other
    columns are ignored, an empty table gives no rows.  Memory of a task is bounded by one pack of a
    megabyte or the longest single text.
    """
    return repeated(docs, word_anchors(width), _finish(width), SCHEMA, carry)
