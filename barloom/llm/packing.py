"""Packing into sequences: order-preserving dynamic programming over cut places.

A task takes its documents in the order in which they come, as one stream of tokens, and cuts it
into windows of at most ``size`` tokens.  Cuts may lie at ends of documents (free), after tokens that
end a sentence, and elsewhere on a grid of ``GRID`` tokens; the last two cost a truncation penalty in
tokens.  With positions p and cost f, counted from the end,

    f(i) = min over j with p(i) < p(j) <= p(i) + size of  size - (p(j) - p(i)) + penalty(j) + f(j),

and as only ``penalty(j) + f(j) - p(j)`` depends on j, the minimum over the sliding range comes from a
monotone queue: each place enters and leaves once.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barloom.llm.tables import texts
from barloom.llm.tokens import byte_balanced, encode, encoding

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEPARATOR = 0
SENTENCE_CUT = 2
FREE_CUT = 12
GRID = 32
#: Tokens that are planned at once; what follows the last but two windows waits for the next plan.
PLAN = 1 << 19


def cut_windows(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indexes of the best cuts.  ``places`` rises from 0, no two neighbours lie more than ``size`` apart."""
    at, cost = places.tolist(), penalty.tolist()
    n = len(at)
    best, after = [0] * n, [n - 1] * n
    queue: deque[tuple[int, int]] = deque()  # rising value, falling place
    for i in range(n - 2, -1, -1):
        j = i + 1
        value = cost[j] + best[j] - at[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
        reach = at[i] + size
        while at[queue[0][1]] > reach:
            queue.popleft()
        value, j = queue[0]
        best[i] = size + at[i] + value
        after[i] = j
    cuts, i = [0], 0
    while i < n - 1:
        i = after[i]
        cuts.append(i)
    return cuts


@lru_cache(1)
def _ends_sentence() -> np.ndarray:
    code = encoding()
    out = np.zeros(code.n_vocab, bool)
    for token in range(code.n_vocab - 1):
        text = code.decode_single_token_bytes(token)
        out[token] = text.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in text
    return out


def _places(ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[::GRID] = FREE_CUT
    penalty[1:][_ends_sentence()[ids]] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[[0, n]] = 0
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def pack(docs: DataFrame, size: int = 1024) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document is its ids and then the id 0, so null and empty texts are one token.  Each row of
    ``docs`` is a document of its own, repeated and null ids included; other columns are ignored; an
    empty table gives no pieces.  Documents keep the order of their partition, and a sequence never
    leaves its task, so nothing is shuffled, a lost task is simply run again, and only the last
    sequence of each task is short for lack of documents.  Memory is bounded by ``PLAN`` tokens and
    the longest single text.  ``sequence_id`` is the partition's number times 2 ** 40 plus a count.
    """

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        held, number = 0, 0

        def plan(last: bool):
            nonlocal waiting, held, number
            ids = np.concatenate([x[3] for x in waiting])
            ends = np.cumsum([len(x[3]) for x in waiting])
            places, penalty = _places(ids, ends)
            cuts = places[cut_windows(places, penalty, size)]
            if not last:
                cuts = cuts[:-2] if len(cuts) > 3 else cuts[:2]
            begins = np.unique(np.concatenate([cuts[:-1], ends[ends < cuts[-1]]]))
            stops = np.append(begins[1:], cuts[-1])
            doc = np.searchsorted(ends, begins, "right")
            window = np.searchsorted(cuts, begins, "right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            lead = ends - np.array([len(x[3]) for x in waiting])
            begun = np.array([x[1] for x in waiting], np.int64)
            out = pa.RecordBatch.from_arrays([
                pa.array([waiting[d][0] for d in doc.tolist()], pa.int64()),
                pa.array(begins - lead[doc] + begun[doc]),
                pa.array(stops - begins),
                pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), stops.tolist())], pa.int64()),
                pa.array([waiting[d][2] for d in doc.tolist()], pa.int64()),
                pa.array(first + number + window),
                pa.array(begins - cuts[window]),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            number += len(cuts) - 1
            rest, upto = [], int(cuts[-1])
            for (doc_id, start, total, own), end in zip(waiting, ends.tolist()):
                if end > upto:
                    skip = max(0, upto - (end - len(own)))
                    rest.append((doc_id, start + skip, total, own[skip:]))
            waiting, held = rest, len(ids) - upto
            return out

        for batch in batches:
            for part in byte_balanced(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text), np.uint32(SEPARATOR))
                    waiting.append((doc_id, 0, len(ids), ids))
                    held += len(ids)
                    if held >= PLAN:
                        yield plan(False)
        if waiting:
            yield plan(True)

    return texts(docs).mapInArrow(run, SCHEMA)
