"""Running a stream over files in bounded micro-batches."""

from __future__ import annotations

import contextlib
import math
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BatchHandler = Callable[[DataFrame, int], None]

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive, at most ``files_per_batch`` per micro-batch.

    The path may be a folder, a pattern or, written as a pattern, one file.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their keyed state in RocksDB: on disk and in the checkpoint, not in the heap."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STATE_STORE) if before is None else spark.conf.set(_STATE_STORE, before)


class _Stopped(Exception):
    """Ends a stream before a batch that has not begun."""


def between_batches(handler: BatchHandler, stop: Callable[[], bool]) -> BatchHandler:
    """``handler``, but once ``stop()`` holds no further batch begins: the stream ends with the last one whole.

    The batch that did not begin is the first of the next run.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if stop():
            raise _Stopped(f"stopped before batch {batch_id}")
        handler(batch, batch_id)

    return handle


def ended(query, timeout: float | None = None) -> bool:
    """Wait for a stream to end; false when a soft stop or the time ended the wait. Other failures are raised."""
    try:
        return query.awaitTermination() is not False if timeout is None else query.awaitTermination(timeout)
    except StreamingQueryException as error:
        if f"{__name__}.{_Stopped.__name__}: " not in str(error):
            raise
        return False


def drain(
    stream: DataFrame,
    handler: BatchHandler,
    checkpoint: str,
    timeout: float | None = None,
    stop: Callable[[], bool] = lambda: False,
    mode: str = "append",
) -> bool:
    """Process what has arrived and stop; no batch begins after ``timeout`` seconds or once ``stop()`` holds.

    Batches that have begun are ended, so no state is left half written. ``mode`` is the
    output mode, ``update`` for a stream that aggregates.
    Returns whether everything was processed. Failures are raised.
    """
    deadline = math.inf if timeout is None else time.monotonic() + timeout
    handler = between_batches(handler, lambda: time.monotonic() >= deadline or stop())
    query = (
        stream.writeStream.foreachBatch(handler)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return ended(query)


def follow(
    stream: DataFrame,
    handler: BatchHandler,
    checkpoint: str,
    every: str = "30 seconds",
    stop: Callable[[], bool] = lambda: False,
):
    """Keep processing, one micro-batch per period, until ``stop()`` holds; returns the running query.

    ``ended`` waits for it. ``stop`` is asked when a batch is about to begin.
    """
    return (
        stream.writeStream.foreachBatch(between_batches(handler, stop))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
