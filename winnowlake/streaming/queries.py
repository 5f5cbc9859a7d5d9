"""Queries from a stream: each micro-batch runs the batch plan against a stored index.

Queries do not depend on one another, so there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import query
from ..operators.index import Index


def run(index: Index, queries: DataFrame, path: str, checkpoint: str, ratio: float = 1.0, trigger: dict | None = None):
    """Start a streaming query that appends hits (query.run's columns) to path.

    A micro-batch writes to a folder of its own number, so one that is repeated after a failure
    replaces its own hits."""

    def each(batch: DataFrame, number: int) -> None:
        hits = query.run(index, batch, ratio)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
