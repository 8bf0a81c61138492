"""Labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import texts

#: Bounds of a training sample: rows of each class, and bytes of one text (longer ones are scored whole but not fitted).
ROWS_OF_CLASS = 1500
TEXT_BYTES = 1 << 16


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = ROWS_OF_CLASS) -> list[tuple[str, int]]:
    """At most ``rows`` texts of each class with their label, for fitting on the driver.

    Only labelled rows with ``learn`` true; the choice follows a hash of the id.  Several labels of
    one document count as their maximum, null labels and ids as none.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.filter(learn & F.col("y").isin(0, 1))
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    chosen = known.filter("y = 0").orderBy(order, "doc_id").limit(rows).union(known.filter("y = 1").orderBy(order, "doc_id").limit(rows))
    found = (
        texts(docs).filter(F.octet_length("text") <= TEXT_BYTES)
        .join(F.broadcast(chosen), "doc_id")  # 2 * rows ids
        .select("text", "y", order.alias("k"), "doc_id")
        .orderBy("k", "doc_id", "text").limit(2 * rows)  # repeated documents stay within the bound
    )
    return [(r.text, r.y) for r in found.collect()]
