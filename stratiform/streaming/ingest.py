"""File streams into raw and validated tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratiform.operators.bronze import bronze
from stratiform.operators.cdc import classify_changes, split_changes


def bronze_stream(
    stream: DataFrame, keys: Sequence[str], audit_ts: datetime, source_system: str, source_file: bool = True
) -> DataFrame:
    """Raw streaming table: the batch operator on a file stream."""
    return bronze(stream, keys, audit_ts, source_system, source_file)


def closed_days(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows by day, each day once it is over by `delay`; its state is dropped then, and rows after that are left out."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.col("window.start").cast("date").alias("date"), "row_count")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is new to a Parquet table, then stop. The checkpoint remembers what was read."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def quarantine_batch(
    batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], audit_ts: datetime, source_system: str
) -> None:
    """Write the valid and the rejected side of one batch, reading the source once.

    Each side has a folder per batch that a repeated batch overwrites.
    """
    classified = classify_changes(batch, keys).persist()
    try:
        valid, rejected = split_changes(classified, audit_ts, source_system)
        valid.write.mode("overwrite").parquet(f"{path}/valid/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
    finally:
        classified.unpersist()


def quarantine_stream(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], audit_ts: datetime, source_system: str
) -> StreamingQuery:
    """Split a change stream into `path/valid` and `path/rejected`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        quarantine_batch(batch, batch_id, path, keys, audit_ts, source_system)

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
