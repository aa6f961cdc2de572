"""Keyed results kept up to date by a stream: current state, history, aggregates.

Every batch writes what it changed into a folder of its own, `batch=N`; a batch that runs again after a
failure writes the same folder anew, so nothing counts twice. Bytes written follow the batch, not the
table. Readers fold the folders: the latest row a key, or the history of the whole log, by the same
operators as in batch. Late rows need no care, since the folds go by the business sequence. What is
kept between batches is Spark's own state (one row a key) or nothing. A result folder belongs to one
checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratiform.operators.history import CONTROL_COLUMNS, latest_rows, one_per_sequence, scd1, scd2
from stratiform.session import setting

BATCH = "batch"


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch to its folder, over an earlier run of the same batch.

    Spark turns AQE off for streams with state; the write is a job of its own, in which the rebalance
    hint gives few files of even size.
    """
    with setting(batch.sparkSession, "spark.sql.adaptive.enabled", "true"):
        batch.hint("rebalance").write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches with their batch number; none before the first batch."""
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored)


def _run(rows: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scd1_stream(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sequence: str, tie: Sequence[str] = ()
) -> StreamingQuery:
    """Keep the latest row per key in Spark's state; a batch writes the rows of the keys it meets.

    Deleted keys stay as tombstones, so a late older row cannot bring a key back.
    """
    return _run(latest_rows(changes, keys, sequence, tie), path, checkpoint, "update")


def scd1_state(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    sequence: str,
    tie: Sequence[str] = (),
    operation: str | None = "cdc_operation",
    exclude: Sequence[str] = CONTROL_COLUMNS,
) -> DataFrame:
    """Current rows of an `scd1_stream` over changes of `schema`, deleted keys left out."""
    rows = read_batches(spark, path, schema).drop(BATCH)
    return scd1(rows, keys, sequence, tie, operation=operation, exclude=exclude)


def scd2_stream(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sequence: str, tie: Sequence[str] = ()
) -> StreamingQuery:
    """Keep the change log, copies within a batch merged. A late row moves the end of an older version,
    so the history is read from the log and never patched."""

    def body(batch: DataFrame, batch_id: int) -> None:
        write_batch(one_per_sequence(batch, keys, sequence, tie), batch_id, path)

    return (
        changes.writeStream.foreachBatch(body)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scd2_state(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    sequence: str,
    tie: Sequence[str] = (),
    **options,
) -> DataFrame:
    """History of an `scd2_stream` over changes of `schema`; options as of `scd2`."""
    return scd2(read_batches(spark, path, schema).drop(BATCH), keys, sequence, tie, **options)


def aggregate_stream(aggregate: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a streaming aggregate: each batch writes the groups it changed, in full."""
    return _run(aggregate, path, checkpoint, "update")


def aggregate_state(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Current groups of an `aggregate_stream` of `schema`: of each, what its latest batch wrote."""
    return latest_rows(read_batches(spark, path, schema), keys, BATCH).select(*schema.names)
