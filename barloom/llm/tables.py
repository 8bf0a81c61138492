"""Reading the tables and writing intermediate ones to the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame after a round trip through a table in the shared folder: fixed rows, no lineage."""
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of a table that may have any other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
