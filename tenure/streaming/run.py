"""Running a stream, over everything available or on and on, with replay-safe batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Let the queries started within keep their state in RocksDB, which may
    outgrow the executors' memory."""
    before = spark.conf.get(_PROVIDER_KEY, None)
    spark.conf.set(_PROVIDER_KEY, _PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER_KEY)
        else:
            spark.conf.set(_PROVIDER_KEY, before)


def keep_running(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    every: str,
) -> StreamingQuery:
    """Start a query that takes what has come, a batch ``every`` so often, until stopped."""
    return (
        stream.writeStream.foreachBatch(on_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def drain(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process all that the source holds, then stop."""
    query = (
        stream.writeStream.foreachBatch(on_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def once_per_event(stream: DataFrame, key: str, at: str, within: str | None) -> DataFrame:
    """Drop repeated events early, where the source bounds how late they come.

    The sinks are safe against repeats by key, so this only saves work; without
    a bound (the default) no event is dropped and no state is kept.
    """
    if within is None:
        return stream
    timed = stream.withColumn("_at", stream[at].cast("timestamp")).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")
