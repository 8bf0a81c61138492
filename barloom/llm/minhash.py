"""Near duplicates: MinHash with banding, verified links, connected components.

Every document becomes the set of its distinct five-word shingles, and the set a signature of
``BANDS * ROWS`` minima under universal hashes.  Equal sets are one class from the start.  Classes that
agree in a whole band are candidates.  Candidates are compared by signature, and what may be similar
enough is confirmed on full sets.  Links join classes into components.

Within a band's group not all pairs are compared.  First every member meets the group's least and
greatest member; the links found make components.  Then only members of groups that still hold several
components meet, and of these only those of different components: within a component more links would
change nothing.  Such a pair leaves the join only in its first common band, and only if a longer
signature of ``SKETCH`` one-bit minima, compared in the join itself, says that it may be similar enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.tables import texts, written
from barloom.llm.textarrays import BASES, LOWER, flat, mix, prefix, span_hash, word_names, words
from barloom.llm.tokens import byte_balanced

SHINGLE = 5
BANDS, ROWS = 52, 5
#: A pair at the threshold of 0.75 shares no band with probability (1 - 0.75 ** 5) ** 52, under one in a million.
SIMILAR = (75, 100)
#: Signatures may agree this much less than the threshold (five standard deviations) before the sets decide.
SLACK = 5 * (0.75 * 0.25 / (BANDS * ROWS)) ** 0.5
BLOCK = 64
#: One-bit minima agree with probability (1 + similarity) / 2; a pair at the threshold is four and a half
#: standard deviations above this many equal bits.
SKETCH = 4096
LEAST_BITS = int(SKETCH * (0.875 - 4.5 * (0.875 * 0.125 / SKETCH) ** 0.5))
SETS = "doc_id long, n_shingles long, key1 long, key2 long, signature binary"
LINKS = "u long, v long"


def _universal(n: int = BANDS * ROWS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text; a short text is one shingle, a text without words none."""
    data, offsets = flat(column)
    data = LOWER[data]
    begin, end, before = words(data, offsets)
    sums = prefix(word_names(data, begin, end), BASES[0])
    last = np.maximum(before[1:] - SHINGLE + 1, before[:-1] + 1)
    last[before[1:] == before[:-1]] = before[:-1][before[1:] == before[:-1]]
    stops = np.minimum(np.arange(len(begin)) + SHINGLE, len(begin))
    for k in np.flatnonzero(np.diff(before) < SHINGLE):
        stops[before[k]:before[k + 1]] = before[k + 1]
    names = span_hash(sums, np.arange(len(begin)), stops, BASES[0])
    return [np.unique(names[a:b]) for a, b in zip(before[:-1].tolist(), last.tolist())]


def _minima(sets: list[np.ndarray], hashes: tuple[np.ndarray, np.ndarray]):
    """Minima of all sets, none of them empty, under one hash after the other."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for a, b in zip(*hashes):
        yield np.minimum.reduceat(x * a + b, at)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set under every hash (sets x hashes); an empty set has the greatest value everywhere."""
    out = np.full((len(sets), BANDS * ROWS), 2**32 - 1, np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        out[full] = np.stack(list(_minima([sets[k] for k in full], _universal())), 1)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One bit of each of ``SKETCH`` further minima, packed into longs (sets x longs)."""
    out = np.zeros((len(sets), SKETCH // 8), np.uint8)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        bits = np.empty((SKETCH, len(full)), bool)
        for h, least in enumerate(_minima([sets[k] for k in full], _universal(SKETCH, 23))):
            bits[h] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
        out[full] = np.packbits(bits, axis=0).T
    return out.view(np.int64)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                marks = signatures(sets)
                keys = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets], object)
                halves = [np.array([(int(k) >> s) & (2**64 - 1) for k in keys], np.uint64).view(np.int64) for s in (0, 64)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[0]), pa.array(halves[1]),
                    pa.array([m.tobytes() if len(s) else None for m, s in zip(marks, sets)], pa.binary()),
                ], names=["doc_id", "n_shingles", "key1", "key2", "signature"])

    return texts(docs).mapInArrow(run, SETS)


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node, number): one row for each band of each class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS)
            cells = band_names(marks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(1, BANDS + 1, dtype=np.int32), batch.num_rows)),
                ], names=["band", "node", "number"],
            )

    return nodes.select("node", "signature").mapInArrow(run, "band long, node long, number int")


def band_names(marks: np.ndarray) -> np.ndarray:
    """One 64-bit name per band, the band's number included."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), marks.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, k])
    return out


def _blocks(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    n = table.num_rows
    sets = [np.frombuffer(b, np.uint64) for b in table.column("names").to_pylist()]
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(n, BANDS * ROWS)
    return table.column("node").to_numpy(), sets, marks


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union of two sorted sets."""
    part, whole = SIMILAR
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return whole * both >= part * (len(a) + len(b) - both)


def _confirm(table: pa.Table) -> pa.Table:
    """Links between the members (role 0) and their leader (role 1), signatures first, then sets."""
    u, v = [], []
    role = table.column("role").to_numpy()
    left, right = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
    if left.num_rows and right.num_rows:
        least = SIMILAR[0] / SIMILAR[1] - SLACK
        (a_id, a_set, a_mark), (b_id, b_set, b_mark) = _blocks(left), _blocks(right)
        for j in range(len(b_id)):
            close = (a_mark == b_mark[j]).mean(1) >= least
            for i in np.flatnonzero(close):
                if a_id[i] != b_id[j] and similar(a_set[i], b_set[j]):
                    u.append(int(a_id[i]))
                    v.append(int(b_id[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _named(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, names, signature, sketch, cells) of the wanted nodes; cells are the names of the bands."""

    def run(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                marks = signatures(sets)
                cells = band_names(marks.reshape(len(sets), BANDS, ROWS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary()),
                    pa.array(list(sketches(sets)), pa.list_(pa.int64())), pa.array(list(cells), pa.list_(pa.int64())),
                ], names=["node", "names", "signature", "sketch", "cells"])

    chosen = texts(docs).join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "node long, names binary, signature binary, sketch array<long>, cells array<long>")


def _links(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Confirmed links among (leader, node); a leader's set is sent once for each block of its members."""
    spark = pairs.sparkSession
    pairs = written(spark, pairs, "pairs")
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("size"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK).cast("long")).alias("block")
    pairs = pairs.join(sizes, "leader").select("leader", "node", block)
    columns = ("leader", "block", "node", "names", "signature")
    members = pairs.join(named, "node").select(*columns, F.lit(0).alias("role"))
    leaders = pairs.select("leader", "block").distinct().withColumn("node", F.col("leader")).join(named, "node").select(*columns, F.lit(1).alias("role"))
    return members.unionByName(leaders).groupBy("leader", "block").applyInArrow(_confirm, LINKS)


def _unlike_pairs(split: DataFrame) -> DataFrame:
    """(leader, node) of one band and of different components, in their first common band, if their sketches are close."""
    a, b = split.alias("a"), split.alias("b")
    differ = " + ".join(f"bit_count(a.sketch[{k}] ^ b.sketch[{k}])" for k in range(SKETCH // 64))
    condition = f"""a.band = b.band AND a.c < b.c AND {SKETCH} - ({differ}) >= {LEAST_BITS}
        AND array_position(zip_with(a.cells, b.cells, (x, y) -> x = y), true) = a.number"""
    return a.join(b, F.expr(condition)).select(F.col("b.node").alias("leader"), F.col("a.node").alias("node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``, a document's set holds its distinct
    five-word shingles; fewer words are one shingle, none are an empty set, linked with nothing.
    Documents are linked if 100 * intersection >= 75 * union.  component_id is the least doc_id
    reachable, kept marks the document that has it as its id.  Rows that share a doc_id are one
    document whose texts all count.  A null doc_id is linked with nothing, has no component and is
    kept.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = written(spark, _sets(docs), "sets")
    known = sets.filter("signature is not null and doc_id is not null")
    classes = known.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    nodes = written(
        spark,
        known.join(classes.withColumnRenamed("node", "doc_id"), ["key1", "key2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "signature"),
        "nodes",
    )
    bands = _bands(nodes)
    ends = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = written(spark, bands.join(ends, "band"), "members")
    named = written(spark, _named(docs, members.select("node").distinct()), "named")

    led = members.select(F.col("low").alias("leader"), "node").filter("leader != node").unionByName(
        members.select(F.col("high").alias("leader"), "node").filter("node not in (low, high)")
    )
    links = written(spark, _links(led.distinct(), named), "links")
    first = written(spark, components(links), "components")

    # groups that still hold several components: members of different components meet
    placed = members.select("band", "node", "number").join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    split = placed.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("band")
    split = placed.join(split, "band", "left_semi").join(named.select("node", "sketch", "cells"), "node")
    late = written(spark, _links(_unlike_pairs(written(spark, split, "split")).distinct(), named), "late")

    # equal sets and equal ids tie a document's rows to its classes
    same = known.select("doc_id", "key1", "key2").join(classes, ["key1", "key2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    reached = written(spark, components(links.unionByName(late).unionByName(same)), "components")
    out = sets.select("doc_id", "n_shingles").join(reached, F.col("doc_id") == F.col("node"), "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that of the least id, with all its columns; rows with a null id stay.

    Rows that share an id are documents of their own, in the order of a hash of their texts: unlike texts both
    stay, of equal rows of one id one.
    """
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null")
    clash = known.groupBy("doc_id").count().filter("count > 1")
    if clash.isEmpty():
        ids = near_duplicates(known).filter("kept").select("doc_id")
        stay = known.join(ids, "doc_id", "left_semi")
    else:  # numbers in the order of id and hash take the place of the ids
        name = F.coalesce(F.sha2("text", 256), F.lit("")).alias("_text_name")
        keys = known.select("doc_id", name).distinct().repartitionByRange("doc_id", "_text_name").sortWithinPartitions("doc_id", "_text_name")
        keys = written(spark, keys.withColumn("_number", F.monotonically_increasing_id()), "numbers")
        rows = written(spark, known.withColumn("_text_name", name).join(keys, ["doc_id", "_text_name"]).dropDuplicates(["_number"]), "numbered")
        numbers = near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("_number"))
        stay = rows.join(numbers, "_number", "left_semi").select(*docs.columns)
    return stay.unionByName(docs.filter("doc_id is null"))
