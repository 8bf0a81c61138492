"""A manifest of a table's files: which keys a file can hold, known without opening it.

For every file it keeps the least and greatest hash of its keys and the words of a Bloom filter, one
row for each word with a bit set.  Keys to be looked up are hashed the same way and joined with those
words, so only files that pass for some key are opened.  A file that holds a key always passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key, and words of 64 bits of a filter: 2 ** 20 bits, good for some hundred thousand keys a file.
HASHES, WORDS = 4, 1 << 14
FILES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("word", T.LongType()), T.StructField("bits", T.LongType()),
    T.StructField("least", T.LongType()), T.StructField("greatest", T.LongType()),
])


def _key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _marks(rows: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """key, word and bit: ``HASHES`` rows for each row."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.pmod(F.xxhash64("_key", F.lit(k)), F.lit(WORDS * 64)).alias("bit")) for k in range(HASHES)]))
    marked = rows.select(*more, _key(keys).alias("_key")).withColumn("_at", at)
    return marked.select(*more, "_key", F.shiftright("_at.bit", 6).alias("word"), F.expr("shiftleft(1L, int(_at.bit & 63))").alias("bit"))


def describe(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows of the files that ``rows`` reads; bits meet in a map-side combine."""
    rows = rows.select(*keys, F.input_file_name().alias("file"))
    words = _marks(rows, keys, "file").groupBy("file", "word").agg(F.bit_or("bit").alias("bits"))
    ends = rows.groupBy("file").agg(F.min(_key(keys)).alias("least"), F.max(_key(keys)).alias("greatest"))
    return words.join(ends, "file").select(*FILES.fieldNames())


def matching(manifest: DataFrame, rows: DataFrame, keys: Sequence[str]) -> list[str]:
    """Files that may hold the key of some row."""
    marks = _marks(rows.select(*keys).distinct(), keys)
    met = marks.join(manifest, "word").filter(
        (F.col("bits").bitwiseAND(F.col("bit")) != 0) & (F.col("_key") >= F.col("least")) & (F.col("_key") <= F.col("greatest")))
    # two of a key's hashes may name one bit; each counts
    passed = met.groupBy("file", "_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES)
    return sorted(r["file"] for r in passed.select("file").distinct().collect())
