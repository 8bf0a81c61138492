"""Token ids in files: documents in ascending order of their ids, compressed by Re-Pair in blocks.

A file is a Parquet file of the shared folder; each of its rows is a block (``repair``) with its
number, counts and range of ids, so that any store that Spark reaches will do.  Documents are dealt
by ranges of ids and sorted, a task cuts its range into blocks, and the token position of each block
follows from the counts of the blocks before it.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import word_tokens
from barloom.llm.repair import Block, encode_block
from barloom.llm.tables import texts
from barloom.llm.tokens import byte_balanced
from barloom.session import checkpoint_dir

BLOCK_SCHEMA = "block long, docs long, n_ids long, first_id long, last_id long, data binary"
ID_SCHEMA = "block long, inner long, doc_id long, n_tokens long, ids_crc32 long"
#: Tokens from which a block is closed; a longer document makes a longer block.
BLOCK = 1 << 20
#: Bytes of text encoded together: the more, the fewer words are merged again.
_TOGETHER = 1 << 23
_TASK = 32  # bits of a block's number within its task
_FAN = 10  # bits by which the levels of the running count narrow


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The blocks of all documents, in ascending order of (doc_id, a hash of the text); null ids come first.

    Null and empty texts have the end id only.  Rows that share an id are documents of their own, in
    the order of their texts' hashes; many such rows may lie in several tasks.  Other columns are
    ignored; an empty table gives no blocks.  Memory is bounded by one block and the longest text.
    """
    keyed = texts(docs).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "_hash", "_row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_hash", "_row")

    def run(batches):
        first, number = TaskContext.get().partitionId() << _TASK, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def close():
            nonlocal number, held
            ends = np.cumsum([len(x) for x in ids])
            data = encode_block(names, np.concatenate(ids), ends, word_tokens.BASE)
            out = pa.RecordBatch.from_arrays([
                pa.array([first + number], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()),
                pa.array(names[:1], pa.int64()), pa.array(names[-1:], pa.int64()), pa.array([data], pa.binary()),
            ], names=["block", "docs", "n_ids", "first_id", "last_id", "data"])
            number += 1
            held = 0
            ids.clear()
            names.clear()
            return out

        for batch in batches:
            for part in byte_balanced(batch, "text", _TOGETHER):
                found = word_tokens.encode_all(part.column("text"))
                pa.default_memory_pool().release_unused()  # the words
                for doc_id, own in zip(part.column("doc_id").to_pylist(), found):
                    ids.append(np.append(np.frombuffer(own.as_buffer(), "<u2"), np.uint16(word_tokens.END)))
                    names.append(doc_id)
                    held += len(ids[-1])
                    if held >= size:
                        yield close()
        if ids:
            yield close()

    return dealt.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA)


def write_ids(docs: DataFrame, path: str | None = None, size: int = BLOCK) -> str:
    """Write the files of ``docs`` and return their folder (a new one in the shared folder if none is named)."""
    spark = docs.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"llm-token-files-{uuid.uuid4().hex[:12]}")
    blocks(docs, size).write.parquet(path)
    return path


def _positions(counts: DataFrame) -> DataFrame:
    """block and the ids of all blocks before it: counts by task, by 1,024 tasks and by 1,048,576 tasks."""
    task = F.shiftright("block", _TASK)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))
    levels = [counts.select(task.alias("g0"), "block", "n_ids").withColumn("at", running("n_ids", before("g0").orderBy("block")))]
    key = "g0"
    for level in (1, 2):
        upper = f"g{level}"
        total = levels[-1].groupBy(key).agg(F.sum("n_ids").alias("n_ids")).withColumn(upper, F.shiftright(key, _FAN))
        levels.append(total.withColumn(f"at{level}", running("n_ids", before(upper).orderBy(key))))
        key = upper
    top = levels[-1].groupBy(key).agg(F.sum("n_ids").alias("n_ids")).withColumn("at3", running("n_ids", before().orderBy(key)))
    out = levels[0]
    for level, lower in ((1, "g0"), (2, "g1")):
        out = out.join(levels[level].drop("n_ids"), lower)
    return out.join(top.drop("n_ids"), "g2").select("block", (F.col("at") + F.col("at1") + F.col("at2") + F.col("at3")).alias("before"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                block = Block.read(data.as_py())
                ids, ends = block.all()
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), number, np.int64)), pa.array(starts), pa.array(block.doc_ids, pa.int64()), pa.array(ends - starts),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ], names=["block", "inner", "doc_id", "n_tokens", "ids_crc32"])

    found = stored.select("block", "data").mapInArrow(run, ID_SCHEMA)
    at = _positions(stored.select("block", "n_ids"))
    return found.join(at, "block").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of that id (usually one): only blocks whose range holds it are read, and only it is expanded."""
    near = spark.read.schema(BLOCK_SCHEMA).parquet(path).filter((F.col("last_id") >= doc_id) & (F.coalesce("first_id", F.lit(doc_id)) <= doc_id))
    out = []
    for r in near.select("data").toLocalIterator():
        block = Block.read(bytes(r["data"]))
        out += [block.document(i) for i, d in enumerate(block.doc_ids) if d == doc_id]
    return out


def token_files(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to files and return what reading them gives: one row for each row of ``docs``."""
    return read_ids(docs.sparkSession, write_ids(docs))
