"""Removal of repeated byte strings by names of spans at chosen suffixes.

Strings are compared through ``WIDTH`` bytes.  Nothing is sorted and there are no digit passes: instead
of a most-significant-digit sort of all suffixes, equality of hashed names is asked by grouping, because
a sort would shuffle eight bytes or more per byte of text.  In each window one suffix is chosen by content
(the least hash of eight bytes), so that equal windows choose at the same offset, and the others follow
from it.  First the chosen suffixes are grouped by the name of their first ``CORE`` bytes; those alone
leave.  Then by the name of the span of all windows that chose the suffix; groups of equal spans are
repeated windows as they stand.  Last, where a group of the first name holds different spans, the single
windows are grouped by a name of their whole width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.repeats import Anchors, repeated
from barloom.llm.textarrays import Spans, _coefficients, covered

WIDTH = 200
CORE = 64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def least_suffix(data: np.ndarray, reach: int) -> np.ndarray:
    """For each place, the place of the least 8-byte hash among it and the next ``reach - 1`` (the leftmost of equals)."""
    n = len(data)
    table = (_coefficients(31) >> np.uint64(32)).astype(np.uint32)
    h = table[data]
    for step, odd in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        nxt = np.zeros(n, np.uint32)
        nxt[:n - step] = h[step:]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(odd) + nxt
        h ^= h >> np.uint32(13)
    best = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        out = best.copy()
        np.minimum(best[:n - step], best[step:], out=out[:n - step])
        best, width = out, width + step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def byte_anchors(width: int = WIDTH, core: int = CORE) -> Callable[[np.ndarray, np.ndarray], Anchors]:
    core = min(core, max(1, width // 3))

    def run(data: np.ndarray, offsets: np.ndarray) -> Anchors:
        named = Spans.of_bytes(data).names
        valid = np.zeros(len(data) + 1, np.int64)
        inside = np.flatnonzero(np.diff(offsets) >= width)
        np.add.at(valid, offsets[inside], 1)
        np.add.at(valid, offsets[inside + 1] - width + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(starts):
            return Anchors(starts, starts, starts.astype(np.uint64), np.zeros((0, 2), np.uint64), lambda s: named(s, s + width))
        at = least_suffix(data, width - core + 1)[starts]
        cut = np.ones(len(starts), bool)
        cut[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(starts)) - 1
        first, last, at = starts[begin], starts[end], at[begin]
        return Anchors(first, last, named(at, at + core)[:, 0], named(first, last + width), lambda s: named(s, s + width))

    return run


def _finish(width: int):
    def run(ids: list, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        gone = covered(starts, width, len(data))
        removed, spans, digests, kept = [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = gone[a:b]
            left = data[a:b][~own].tobytes()
            removed.append(int(own.sum()))
            spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0]))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.array(digests), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def drop_repeated_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of ``docs`` without the bytes that lie in a string of ``width`` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the kept bytes.
    Strings never cross documents and are judged on the input.  Null texts count as empty, repeated
    rows and null ids are documents of their own, other columns are ignored, an empty table gives no
    rows.  Memory of a task is bounded by one pack of a megabyte or the longest single text.
    """
    return repeated(docs, byte_anchors(width), _finish(width), SCHEMA)
