"""Which windows of a corpus occur more than once: the part that both repeat removers share.

A remover names *anchors*: places chosen by content alone, so that equal windows hold their anchor at
the same offset.  All windows of one anchor form one run of neighbouring windows.  Three facts are then
asked of the whole corpus, each by a shuffle of 64-bit names:

1. the *span* of an anchor (the text of all its windows): if it occurs twice, so do all its windows;
2. the *core* of an anchor (text inside each of its windows): if one span only has it, nothing else
   can equal its windows;
3. for the rest, spans that share a core but differ, the windows themselves, one copy of each span.

Documents lie in packs of about a megabyte.  A pack sends the distinct names of its anchors, cut into
buckets by name, as one array per bucket; a bucket answers with one byte per name.  A name that is
frequent in a pack is sent once, so a hot passage costs one entry per pack.  Spans and windows are
named with 128 bits; answers are stored tables, so a lost executor repeats one step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import texts, written
from barloom.llm.textarrays import concat_ranges, flat
from barloom.llm.tokens import byte_balanced

PACK_BYTES = 1 << 20
#: Input bytes for each bucket, and the least number of buckets.
BUCKET_BYTES = 2 << 20
LEAST_BUCKETS = 256
PACKS = "pack long, n_bytes long, doc_ids array<long>, lengths array<long>, data binary, carried array<struct<{}>>"
KEYS = "bucket long, pack long, names binary"
DUP, FIRST, MIXED = 1, 2, 4


@dataclass
class Anchors:
    """Per anchor: first and last window, name of the core, both names of the span; names of any windows."""

    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    span: np.ndarray
    windows: Callable[[np.ndarray], np.ndarray]


def _types(docs: DataFrame, carry: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)


def packs(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``docs`` in packs, stored, with the columns named in ``carry``; null texts are empty, null ids stay null."""
    held = [f"_carried_{k}" for k in range(len(carry))]
    frame = texts(docs, *(F.col(f"`{c}`").alias(h) for c, h in zip(carry, held)))
    fields = _types(docs, carry) or "none: int"

    def run(batches):
        first, count = TaskContext.get().partitionId() << 40, 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in byte_balanced(batch, "text", PACK_BYTES):
                data, offsets = flat(part.column("text"))
                n = part.num_rows
                rest = pa.StructArray.from_arrays([part.column(h) for h in held] or [pa.nulls(n, pa.int32())], names=list(carry) or ["none"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([first + count], pa.int64()), pa.array([len(data)], pa.int64()),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                    pa.array([pack(data.tobytes())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rest),
                ], names=["pack", "n_bytes", "doc_ids", "lengths", "data", "carried"])
                count += 1

    return written(docs.sparkSession, frame.mapInArrow(run, PACKS.format(fields)), "packs")


def opened(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a pack."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"])), np.uint8)
    return row["doc_ids"], data, np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of an (n, 2) array in order, the place of each row among them, and their counts."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    ranked = names[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    group = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    return ranked[new], place, np.bincount(group, minlength=int(new.sum()))


def _cores(a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cores with the least and the greatest span name beside each, and the place of each anchor's core."""
    cores, place = np.unique(a.core, return_inverse=True)
    low = np.full(len(cores), 2**64 - 1, np.uint64)
    high = np.zeros(len(cores), np.uint64)
    np.minimum.at(low, place, a.span[:, 0])
    np.maximum.at(high, place, a.span[:, 0])
    return np.stack([cores, low, high], 1), place


def _dealt(kind: int, names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each name (kinds apart), and the order that puts the buckets one after the other."""
    bucket = (names[:, 0] % np.uint64(buckets)).astype(np.int64) + kind * buckets
    return bucket, np.argsort(bucket, kind="stable")


def _send(kinds: list[np.ndarray], buckets: int, pack: int) -> Iterator[pa.RecordBatch]:
    out: tuple[list, list] = ([], [])
    for kind, names in enumerate(kinds):
        if not len(names):
            continue
        bucket, order = _dealt(kind, names, buckets)
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cuts):
            out[0].append(int(bucket[rows[0]]))
            out[1].append(np.ascontiguousarray(names[rows]).tobytes())
    if out[0]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array([pack] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], names=["bucket", "pack", "names"],
        )


def _received(kinds: list[np.ndarray], buckets: int, answers: list[dict]) -> list[np.ndarray]:
    """The answers in the order of the names sent."""
    found = {a["bucket"]: a["flags"] for a in answers}
    out = []
    for kind, names in enumerate(kinds):
        flags = np.zeros(len(names), np.uint8)
        if len(names):
            bucket, order = _dealt(kind, names, buckets)
            flags[order] = np.frombuffer(b"".join(found[b] for b in np.unique(bucket).tolist()), np.uint8)
        out.append(flags)
    return out


def _answer(buckets: int):
    """Per bucket: which names came from several packs (or several times from one), which entry is the first, which cores have several spans."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("names").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        names = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 3)
        order = np.lexsort((names[:, 1], names[:, 0])) if bucket < buckets else np.argsort(names[:, 0], kind="stable")
        ranked = names[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:, 0] != ranked[:-1, 0]
        if bucket < buckets:  # names of 128 bits and a count
            new[1:] |= ranked[1:, 1] != ranked[:-1, 1]
            at = np.flatnonzero(new)
            many = np.add.reduceat(ranked[:, 2], at) > 1
            flags = np.where(np.repeat(many, np.diff(np.append(at, len(new)))), DUP, 0) | np.where(new, FIRST, 0)
        else:  # cores, with the range of their spans
            at = np.flatnonzero(new)
            many = np.minimum.reduceat(ranked[:, 1], at) != np.maximum.reduceat(ranked[:, 2], at)
            flags = np.where(np.repeat(many, np.diff(np.append(at, len(new)))), MIXED, 0)
        out = np.empty(len(flags), np.uint8)
        out[order] = flags
        cuts = np.cumsum([len(b) // 24 for b in blobs])[:-1]
        return pa.table({
            "pack": table.column("pack"), "bucket": table.column("bucket"), "flags": pa.array([x.tobytes() for x in np.split(out, cuts)], pa.binary()),
        })

    return run


def _asked(sent: DataFrame, buckets: int, column: str) -> DataFrame:
    """Stored answers, one row per pack."""
    answers = sent.groupBy("bucket").applyInArrow(_answer(buckets), "pack long, bucket long, flags binary")
    return written(sent.sparkSession, answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "flags")).alias(column)), column)


def _spans(a: Anchors) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Names of spans and cores as they are sent, and the places of the anchors among them."""
    spans, place, counts = distinct(a.span)
    cores, core_place = _cores(a)
    return [np.column_stack([spans, counts.astype(np.uint64)]), cores], place, core_place


def _open_windows(a: Anchors, buckets: int, answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are known to repeat, windows that must be asked for, and names of the latter."""
    none = np.zeros(0, np.int64)
    if not len(a.first):
        return none, none, np.zeros((0, 2), np.uint64)
    kinds, place, core_place = _spans(a)
    on_span, on_core = _received(kinds, buckets, answers or [])
    dup = on_span[place] & DUP > 0
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True  # one copy within the pack
    ask = (on_core[core_place] & MIXED > 0) & (on_span[place] & FIRST > 0) & first
    known = concat_ranges(a.first[dup], (a.last - a.first + 1)[dup])
    open_ = concat_ranges(a.first[ask], (a.last - a.first + 1)[ask])
    return known, open_, a.windows(open_)


def repeated(docs: DataFrame, anchors: Callable[[np.ndarray, np.ndarray], Anchors], finish: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``finish(doc_ids, data, offsets, starts)`` of every pack, ``starts`` being the windows that occur more than once.

    The columns named in ``carry`` follow those of ``finish``.
    """
    stored = packs(docs, carry)
    schema = ", ".join([schema, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)

    def ask_spans(batches):
        for batch in batches:
            for row in batch.drop_columns(["carried"]).to_pylist():
                _, data, offsets = opened(row)
                a = anchors(data, offsets)
                if len(a.first):
                    yield from _send(_spans(a)[0], buckets, row["pack"])

    def window_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, place, counts = distinct(names)
        return np.column_stack([found, counts.astype(np.uint64)]), place

    def ask_windows(batches):
        for batch in batches:
            for row in batch.drop_columns(["carried"]).to_pylist():
                _, data, offsets = opened(row)
                names = _open_windows(anchors(data, offsets), buckets, row["on_spans"])[2]
                if len(names):
                    yield from _send([window_names(names)[0]], buckets, row["pack"])

    def conclude(batches):
        for batch in batches:
            place = batch.schema.get_field_index("carried")
            for k, row in enumerate(batch.drop_columns(["carried"]).to_pylist()):
                ids, data, offsets = opened(row)
                known, open_, names = _open_windows(anchors(data, offsets), buckets, row["on_spans"])
                if len(open_):
                    sent, at = window_names(names)
                    flags = _received([sent], buckets, row["on_windows"])[0]
                    known = np.concatenate([known, open_[flags[at] & DUP > 0]])
                out = finish(ids, data, offsets, np.unique(known))
                rest = batch.column(place).slice(k, 1).flatten()
                for c, column in zip(carry, rest.flatten() if carry else ()):
                    out = out.append_column(c, column)
                yield out

    on_spans = _asked(stored.mapInArrow(ask_spans, KEYS), buckets, "on_spans")
    told = stored.join(on_spans, "pack", "left")
    on_windows = _asked(told.mapInArrow(ask_windows, KEYS), buckets, "on_windows")
    return told.join(on_windows, "pack", "left").mapInArrow(conclude, schema)
