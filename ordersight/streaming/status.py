"""K7 as a stream: the latest status of every key, whatever order events arrive in.

The state is Structured Streaming's own: one aggregate per key that keeps the event of
the greatest (timestamp, event id), so late events change nothing, ties go by event id,
and an event that is delivered twice counts once. Each trigger passes on the keys whose
event changed (``update`` mode) and stores them under its batch number; a trigger that
is run again replaces its own rows. ``current`` takes the last stored row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """``user_id, status, updated_at, event_id`` of the last event per key, of a batch or a stream."""
    last = F.max(F.struct(F.col("ts"), F.col("event_id"), F.col("event_type"))).alias("last")
    return events.groupBy("user_id").agg(last).select("user_id", F.col("last.event_type").alias("status"), F.col("last.ts").alias("updated_at"),
                                                      F.col("last.event_id").alias("event_id"))


def upsert_stream(events: DataFrame, out_dir: str, checkpoint: str, processing_time: str | None = None):
    """Start the job on a stream of events; returns the streaming query."""
    def store(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch_id}")

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (latest(events).writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """The table as of the last trigger."""
    rows = spark.read.parquet(out_dir)
    cols = [c for c in rows.columns if c not in ("user_id", "batch_id")]
    last = F.max_by(F.struct(*cols), F.col("batch_id")).alias("last")
    return rows.groupBy("user_id").agg(last).select("user_id", "last.*")
