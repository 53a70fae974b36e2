"""Incremental operators on Structured Streaming: a debounced watcher, windows over events, a seen-set sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

FEW = 100_000  # keys of a micro-batch up to this number are sent to every executor, more are joined


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events, users and value by window and type; events later than the watermark are dropped, state is bounded by it."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span.alias("span"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a user's events without a gap, with how many events each has."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("span"), "user_id").agg(F.count("*").alias("events"))


def watch(stream: DataFrame, checkpoint: str, seen: str, key: str, accept: Callable[[DataFrame], DataFrame], out: str, every: str = "30 seconds") -> StreamingQuery:
    """Runs accept on each micro-batch's rows that weren't seen before and appends what it returns to out.

    The trigger's interval is the debounce: a burst of changes within it is one batch. A batch that is run again after a failure
    writes the same folder of its own, so nothing is added twice; keys are seen from the folders of earlier batches only.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if number > 0:
            # folders of earlier batches, pruned by their number; only keys that this batch has are looked at, and they are sent if they are few
            known = spark.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, batch bigint").parquet(seen).filter(F.col("batch") < number).select(key)
            keys = fresh.select(key)
            few = keys.limit(FEW + 1).count() <= FEW
            known = known.join(F.broadcast(keys) if few else keys, key, "left_semi").distinct()
            fresh = fresh.join(known, key, "left_anti")
        fresh = fresh.persist()
        try:
            accept(fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")
            fresh.select(key).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Heartbeat(StreamingQueryListener):
    """Says how a stream goes on: each progress as (name, batch, rows in, rows a second), idle ones too, to a function of one's own."""

    def __init__(self, say: Callable[[str, int, int, float], None]) -> None:
        self.say = say

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.say(event.name or str(event.id), -1, 0, 0.0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.say(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.say(str(event.id), -1, 0, 0.0)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.say(str(event.id), -1, 0, 0.0)
