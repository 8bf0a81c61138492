"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barloom.llm.tables import texts
from barloom.llm.tokens import byte_balanced, encode

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: bytes, tokens and whether there are more than ``limit``.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are
    counted each; an empty table gives no rows; other columns are ignored.  Only lengths leave the
    Python side, batches are cut by bytes and long texts at safe places, so memory is bounded by
    the longest single text.
    """

    def count(batches):
        for batch in batches:
            for part in byte_balanced(batch, "text"):
                n = np.fromiter((len(encode(t)) for t in part.column("text").to_pylist()), np.int64, part.num_rows)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return texts(docs).mapInArrow(count, SCHEMA)
