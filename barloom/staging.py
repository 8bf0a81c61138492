"""Tables between the steps of a pipeline, written once to the shared folder.

Bars, features, signals, labels and trades are stored tables in the data model.  Writing them cuts
the lineage (a lost executor never recomputes the steps before), lets later steps prune columns
and push filters into the scan, and keeps their plans short.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir

_tables: dict[tuple[str, str, str, str], DataFrame] = {}
_held: list[DataFrame] = []
_JOIN_CACHED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
_lock = threading.RLock()


def listing(spark: SparkSession, folder: str) -> str:
    """Fingerprint of the files under ``folder``: their paths, sizes and times.

    A folder that only Spark can list is read through it; the contents are not touched.
    """
    if os.path.isdir(folder):
        found = []
        for at, _, names in os.walk(folder):
            for name in names:
                state = os.stat(os.path.join(at, name))
                found.append((os.path.join(at, name), state.st_size, state.st_mtime_ns))
        return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    row = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return f"{row[0]}:{row[1]}"


def staged(name: str, spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``folder``, built and written at first use in a session.

    Files that changed since then are another input, so the table is built again.
    """
    key = (spark.sparkContext.applicationId, folder, listing(spark, folder), name)
    with _lock:
        if key not in _tables:
            frame = build()
            path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
            frame.write.parquet(path)
            _tables[key] = spark.read.schema(frame.schema).parquet(path)
            release()
        return _tables[key]


def hold(frame: DataFrame) -> DataFrame:
    """Mark a frame that several branches of one plan read, so that it is computed once.

    Cached partitions spill to disk, and a lost executor's partitions are recomputed from lineage.  Spark plans
    the frame when it is marked and would keep all shuffle partitions, most of them empty for a small frame; the
    setting lets it join them as elsewhere.
    """
    conf = frame.sparkSession.conf
    with _lock:
        before = conf.get(_JOIN_CACHED)
        conf.set(_JOIN_CACHED, "true")
        try:
            kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            conf.set(_JOIN_CACHED, before)
    _held.append(kept)
    return kept


def release() -> None:
    """Drop the held frames; results already written do not need them."""
    while _held:
        _held.pop().unpersist()


def forget(spark: SparkSession) -> None:
    """Forget all staged tables, so that the next query builds its own (used by the bench)."""
    release()
    _tables.clear()
    spark.catalog.clearCache()
