"""Incremental indexing with Structured Streaming. The batch plans cover all that is asked; this keeps an index up to date.

Each micro-batch goes through the offline plan and is appended under its batch number, so a batch that is repeated after a
failure replaces its own rows: the sink is exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.plans.lifecycle import index_offline
from lodeseek.plans.providers import Provider


def index_stream(records: DataFrame, provider: Provider, dimensions: int, path: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of records (dataset_id, data_profile, processable) until what is there is done."""

    def write(batch: DataFrame, number: int) -> None:
        index_offline(batch, provider, dimensions).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window with a watermark, for monitoring an ingest; works on a stream and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
