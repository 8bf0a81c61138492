"""Incremental ingestion of a bar stream: first value kept, revisions set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.quality import split_valid
from barloom.schema import IDENTITY, VALUES
from barloom.sources.sinks import read_or_empty


def keep_first(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with the tables bars, revisions and quarantine below ``path``.

    A batch writes only to its own folder and replaces it, so a retried batch changes nothing.
    """
    columns = [*IDENTITY, *VALUES]

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        valid, bad = split_valid(batch)
        stored = read_or_empty(spark, f"{path}/bars", valid.select(*columns, F.lit(0).alias("batch_id")).schema)
        # only the stored bars of the batch's own time range are read (a bound that the file statistics prune by)
        first_ts, last_ts = valid.agg(F.min("ts"), F.max("ts")).first()
        stored = stored.filter((F.col("batch_id") < batch_id) & F.col("ts").between(F.lit(first_ts), F.lit(last_ts))).select(*columns)
        first = valid.groupBy(*IDENTITY).agg(F.min_by(F.struct(*VALUES), "ingest_seq").alias("_v"))
        first = first.select(*IDENTITY, *[F.col(f"_v.{v}").alias(v) for v in VALUES])
        fresh = first.join(stored.select(*IDENTITY), list(IDENTITY), "left_anti")
        kept = stored.join(valid.select(*IDENTITY).distinct(), list(IDENTITY), "left_semi").unionByName(fresh)
        kept = kept.select(*IDENTITY, F.struct(*VALUES).alias("_kept"))
        revised = valid.join(kept, list(IDENTITY)).filter(~F.struct(*VALUES).eqNullSafe(F.col("_kept"))).drop("_kept")
        for name, rows in (("bars", fresh), ("revisions", revised.select(*columns, "received_at")),
                           ("quarantine", bad.select(*columns, "errors"))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        batch.unpersist()

    return apply
