"""Cross-tokenizer alignment: groups of tokens between common byte ends, and how often ids are linked corpus-wide.

A text is a fragment (``fragments``), a very long one many: its byte-range stretches become rows,
Spark deals them out, each task turns its stretches into fragments, and rounds of a tree reduction
join neighbours until one fragment for each text is left.

Texts are kept in packs of some megabytes, with each pair of ids of a pack once.  The pairs' document
counts are summed by Spark, and each pack asks for the counts of its own pairs, so a pair that every
document holds is asked for once a pack and not once a document.  Pairs of very many packs, of which
there are few by the size of the tables, are broadcast; the others are joined by a shuffle.

What only the last step needs of a pack is one compressed value, so that Spark moves rows of some
hundred kilobytes, and a task has the tokens of a few texts of its pack at once.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.fragments import Closed, Fragment, Tokens, grouped, links, spelled
from barloom.llm.tables import texts, written
from barloom.llm.tokens import byte_balanced
from barloom.llm.two_tokens import many, stretch, stretches

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Texts longer than this (in characters) are cut into stretches of ``STRETCH``; ``FAN`` fragments are joined at once.
LONG, STRETCH, FAN = 1 << 16, 1 << 15, 8
#: Bytes of text of a pack, at most unless one text has more.
PACK = 1 << 21
#: Characters of text whose tokens are held at once, at most unless one text has more.
PART = 1 << 18
#: Pairs of more than a 2 ** 16th of all lines of packs, 2 ** 16 of them at most, are joined by broadcast.
FEW = 1 << 16

_PACK_SCHEMA = "pack long, names array<long>, held array<long>, body binary"
#: The body: the texts' digests, their numbers of pairs, the steps from one place to the next, and the links of each pair.
_BODY = pa.schema([
    *((n, pa.list_(pa.int64())) for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")),
    ("shas", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
])
_STRETCH_SCHEMA = "text_no long, doc_id long, part long, parts long, a_text string, a_at long, b_text string, b_at long"
_SIDE = "{0}_a array<long>, {0}_a_ends array<long>, {0}_b array<long>, {0}_b_ends array<long>"
_FRAGMENT_SCHEMA = (
    "text_no long, doc_id long, part long, parts long, cut boolean, whole boolean, n_a long, n_b long, "
    f"{_SIDE.format('prefix')}, {_SIDE.format('suffix')}, groups long, spelled binary, pairs array<long>, times array<long>"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sha(spelled_text) -> str:
    """Digest of the groups' text without its last mark; no groups, no digest."""
    return hashlib.sha256(memoryview(spelled_text)[:-1]).hexdigest() if len(spelled_text) else ""


def _pack(number: int, rows: list[tuple], names: np.ndarray, held: np.ndarray, sizes, places, times) -> pa.RecordBatch:
    """One row: the pairs of the pack, its texts, and for each text the places of its pairs and their links."""
    values = [*map(list, zip(*rows)), sizes, np.diff(places, prepend=places.dtype.type(0)), times]
    body = pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(values, _BODY)], schema=_BODY)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BODY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(body)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    values = [number, names, held, sink.getvalue().to_pybytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=_names(_PACK_SCHEMA))


def _digests(sources: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Digests of some short texts, the number of pairs of each, and these pairs, rising within a text, with their links."""
    found, whole = many([t or "" for t in sources])
    good = [i for i, w in enumerate(whole) if w and sources[i]]
    lengths = np.array([found[i].a_ends[-1] for i in good], np.int64)
    lead = np.cumsum(lengths) - lengths
    joined = Tokens(*(
        np.concatenate([getattr(found[i], c) + (at if c.endswith("ends") else 0) for i, at in zip(good, lead.tolist())] or [np.zeros(0, np.int64)])
        for c in ("a", "a_ends", "b", "b_ends")
    ))
    cuts = joined.cuts()
    owner = np.searchsorted(lead + lengths, cuts)  # a text's last byte is a cut
    doc, a, b, times = links(joined, cuts, owner)
    names, place = np.unique((a << 32) | b, return_inverse=True)
    each, at = np.unique(doc * max(len(names), 1) + place, return_inverse=True)
    times = np.bincount(at, times, len(each)).astype(np.int64)
    of, place = np.divmod(each, max(len(names), 1))
    flat, ends = spelled(joined, cuts) if len(cuts) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    _, _, na, nb = grouped(joined, cuts)
    n_links = np.bincount(owner, na * nb, len(good)).astype(np.int64)
    n_groups = np.bincount(owner, minlength=len(good))
    last = ends[np.cumsum(n_groups) - 1] if len(good) else ends
    rows, begin = [(0, 0, 0, 0, "")] * len(sources), 0
    for at, i in enumerate(good):
        rows[i] = (len(found[i].a), len(found[i].b), int(n_groups[at]), int(n_links[at]), _sha(flat[begin:last[at]]))
        begin = int(last[at])
    sizes = np.zeros(len(rows), np.int64)
    sizes[good] = np.bincount(of, minlength=len(good))
    return rows, sizes, names[place], times


def _packed(number: int, doc_ids: list[int | None], sources: list[str | None]) -> pa.RecordBatch:
    """The pack of some short texts, made from parts of ``PART`` characters."""
    part = np.cumsum([len(t or "") for t in sources]) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sources)]
    rows, sizes, pairs, times = zip(*(_digests(sources[i:j]) for i, j in zip(cuts, cuts[1:])))
    names, places = np.unique(np.concatenate(pairs), return_inverse=True)
    rows = [(doc_id, *row) for doc_id, row in zip(doc_ids, chain(*rows))]
    held = np.bincount(places, minlength=len(names))
    return _pack(number, rows, names, held, np.concatenate(sizes), places.astype(np.int32), np.concatenate(times))


def _short(batches):
    first, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for part in byte_balanced(batch, "text", PACK):
            yield _packed(first + number, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            number += 1


def _cut(batches):
    first, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text, a_at, b_at = text.as_py(), 0, 0
            parts = stretches(text, STRETCH)
            for k, (a, b, c, d) in enumerate(parts):
                row = [first + number, doc_id, k, len(parts), text[a:b], a_at, text[c:d], b_at]
                yield pa.RecordBatch.from_pylist([dict(zip(_names(_STRETCH_SCHEMA), row))], schema=_STRETCH)
                lead = 1 if k == 0 else 0
                a_at += lead + len(text[a:b].encode())
                b_at += lead + len(text[c:d].encode())
            number += 1


_STRETCH = pa.schema([(n, pa.string() if n.endswith("text") else pa.int64()) for n in _names(_STRETCH_SCHEMA)])
_FRAGMENT = pa.schema([
    (n, pa.bool_() if n in ("cut", "whole") else pa.binary() if n == "spelled" else pa.list_(pa.int64()) if "array" in c else pa.int64())
    for c in _FRAGMENT_SCHEMA.split(", ") for n in [c.split()[0]]
])
_SIDES = ("a", "a_ends", "b", "b_ends")


def _row(text_no: int, doc_id, part: int, parts: int, f: Fragment) -> pa.RecordBatch:
    values = [
        text_no, doc_id, part, parts, f.cut, f.whole, f.n_a, f.n_b, *(getattr(f.prefix, s) for s in _SIDES), *(getattr(f.suffix, s) for s in _SIDES),
        f.closed.groups, f.closed.text, f.closed.pairs, f.closed.times,
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(values, _FRAGMENT)], schema=_FRAGMENT)


def _read(table: pa.Table | pa.RecordBatch, i: int) -> Fragment:
    def get(name):
        return table.column(name)[i].as_py()

    def numbers(name):
        return table.column(name)[i].values.to_numpy(zero_copy_only=False)

    sides = [Tokens(*(numbers(f"{side}_{s}") for s in _SIDES)) for side in ("prefix", "suffix")]
    closed = Closed(get("spelled"), get("groups"), numbers("pairs"), numbers("times"))
    return Fragment(sides[0], closed, sides[1], get("cut"), get("n_a"), get("n_b"), get("whole"))


def _fragments(batches):
    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            found, whole = stretch(r["a_text"] or "", r["a_at"], r["b_text"] or "", r["b_at"], r["part"] == 0)
            yield _row(r["text_no"], r["doc_id"], r["part"], r["parts"], Fragment.of(found, whole))


def _join(key: tuple, table: pa.Table) -> pa.Table:
    """One fragment of at most ``FAN`` neighbours."""
    order = np.argsort(table.column("part").to_numpy())
    total = _read(table, int(order[0]))
    for i in order[1:].tolist():
        total = total + _read(table, i)
    head = [table.column(c)[0].as_py() for c in ("text_no", "doc_id", "part", "parts")]
    return pa.Table.from_batches([_row(head[0], head[1], head[2] // FAN, -(-head[3] // FAN), total)])


def _finished(batches):
    """A pack for each long text."""
    for batch in batches:
        for i in range(batch.num_rows):
            f = _read(batch, i)
            number = -1 - batch.column("text_no")[i].as_py()
            closed = f.finished() if f.whole else Closed()
            n_a, n_b = (f.n_a, f.n_b) if f.whole else (0, 0)
            rows = [(batch.column("doc_id")[i].as_py(), n_a, n_b, closed.groups, int(closed.times.sum()), _sha(closed.text))]
            n = len(closed.pairs)
            yield _pack(number, rows, closed.pairs, np.ones(n, np.int64), np.array([n]), np.arange(n, dtype=np.int32), closed.times)


def _long(docs: DataFrame) -> DataFrame:
    """Packs of the long texts, by a tree reduction of their fragments."""
    spark = docs.sparkSession
    cut = written(spark, docs.mapInArrow(_cut, _STRETCH_SCHEMA), "stretches")
    parts = cut.agg(F.max("parts").alias("parts")).first()["parts"] or 0
    now = written(spark, cut.repartition("text_no", "part").mapInArrow(_fragments, _FRAGMENT_SCHEMA), "fragments")
    while parts > 1:
        parts = -(-parts // FAN)
        now = now.withColumn("_of", F.floor(F.col("part") / FAN)).groupBy("text_no", "_of").applyInArrow(lambda k, t: _join(k, t.drop_columns("_of")), _FRAGMENT_SCHEMA)
        now = written(spark, now, "fragments")
    return now.mapInArrow(_finished, _PACK_SCHEMA)


def _finish(key: tuple, packs: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of one pack, with the counts of its pairs."""
    body = pa.ipc.open_stream(packs.column("body")[0].as_buffer()).read_all()
    get = lambda name: body.column(name)[0].values
    counts, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, bool)
    at = found.column("place").to_numpy()
    counts[at], best[at] = found.column("count").to_numpy(), found.column("is_best").to_numpy(zero_copy_only=False)
    places, times = np.cumsum(get("steps").to_numpy()), get("times").to_numpy()
    ends = np.concatenate([[0], np.cumsum(get("sizes").to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(v)])[ends] for v in (times * best[places], times * counts[places])]
    out = [get(c) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*out, pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])), get("shas")], names=_names(SCHEMA))


def align(docs: DataFrame) -> DataFrame:
    """Alignment digest of each row of ``docs``: tokens, groups, links, and the links' corpus-wide counts.

    Null and empty texts, and texts whose bytes one of the vocabularies does not give back, have zeros
    and an empty digest and count for no pair.  Each row is a document of its own, repeated rows and
    null ids included; other columns are ignored; an empty table gives no rows.  A text longer than
    ``LONG`` characters is cut at safe places of each vocabulary; one without any such place is encoded
    whole by one task.  Memory is bounded by a pack, and by the digest of the longest text.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    far = F.coalesce(F.char_length("text") > LONG, F.lit(False))
    packs = docs.filter(~far).mapInArrow(_short, _PACK_SCHEMA).unionByName(_long(docs.filter(far)))
    packs = written(spark, packs, "packs")
    asked = packs.select("pack", F.posexplode(F.arrays_zip("names", "held")).alias("place", "x")).select("pack", "place", F.col("x.names").alias("name"), F.col("x.held").alias("held"))
    counts = asked.groupBy("name").agg(F.sum("held").alias("count"), F.count("*").alias("lines"))
    counts = written(spark, counts.withColumn("a", F.shiftrightunsigned("name", 32)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # one row for each id of A: at most 50,257
    counts = counts.join(F.broadcast(best), "a").select("name", "count", (F.col("count") == F.col("best")).alias("is_best"), "lines")
    lines = counts.agg(F.sum("lines")).first()[0] or 0
    often = F.col("lines") * FEW > F.lit(lines)
    hot = counts.filter(often).drop("lines")  # fewer than FEW rows
    known = asked.drop("held").join(F.broadcast(hot), "name", "left")
    rare = known.filter("count is null").select("pack", "place", "name").join(counts.filter(~often).drop("lines"), "name")
    columns = (F.col("pack").alias("of_pack"), "place", "count", "is_best")
    found = known.filter("count is not null").select(*columns).union(rare.select(*columns))
    return packs.select("pack", "body").groupBy("pack").cogroup(found.groupBy("of_pack")).applyInArrow(_finish, SCHEMA)
