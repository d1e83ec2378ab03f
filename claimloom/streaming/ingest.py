"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimloom.operators.upsert import new_rows
from claimloom.sources.sinks import _exists


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_events(stream: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """The first delivery of each key; state is dropped once the watermark has passed."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, length: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """``start``, ``by``, ``n``, ``total`` of event-time windows; works on batches too. Late rows beyond the watermark are left out of streams."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, lateness)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(window, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(rows: DataFrame, time: str, by: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """``by``, ``start``, ``end``, ``n``: sessions that end after a gap; works on streams and batches."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, lateness)
    return rows.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_new_stream(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose key is not stored yet, and end when the input is read: skip-existing ingestion that resumes.

    A batch that runs again after a failure finds its own rows and appends nothing.
    """

    def store(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        if _exists(batch, target):
            fresh = new_rows(fresh, batch.sparkSession.read.parquet(target), key)
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
