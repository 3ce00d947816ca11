"""Requests as a stream: the batch transforms on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import REQUEST


def verify_stream(spark: SparkSession, requests: str, results: str, checkpoint: str, verify: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run verify over new request files; each micro-batch replaces its own folder, so a retry repeats nothing."""
    rows = spark.readStream.schema(REQUEST).option("multiLine", True).json(requests)

    def each(batch: DataFrame, epoch: int) -> None:
        verify(batch).write.mode("overwrite").json(f"{results.rstrip('/')}/epoch={epoch}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
