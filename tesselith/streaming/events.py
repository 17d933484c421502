"""Streams: append-only logs, feedback kept at its newest, bounded histories, windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselith.operators.retrieval import keep_latest, ranked
from tesselith.sources import published

LOG = "ts string, level string, event string, job_id string, message string"


def log_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """JSON lines as they come; a line that can't be read is dropped."""
    return spark.readStream.schema(schema).json(path, mode="DROPMALFORMED")


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes", by: str = "level") -> DataFrame:
    """Counts per window and key; events later than `late` don't count."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def keep_newest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Each batch is merged into a published store of the newest row per key: only the buckets that hold its keys are written. A batch that runs twice is merged once."""
    return _merging(stream, path, checkpoint, key, lambda d: keep_latest(d, key, [F.desc(order)]))


def bounded_history(stream: DataFrame, path: str, checkpoint: str, by: str, order: str, keep: int = 20) -> StreamingQuery:
    """The same with the newest `keep` rows per key."""
    return _merging(stream, path, checkpoint, [by], lambda d: ranked(d, by, [F.desc(order)], keep).drop("rank"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The store as of its newest batch."""
    return published.read(spark, path)


def _merging(stream: DataFrame, path: str, checkpoint: str, key: list[str], reduce) -> StreamingQuery:
    def merge(batch: DataFrame, number: int) -> None:
        published.merge(batch, path, key, lambda old, new: reduce(old.unionByName(new)), generation=number + 1)
        published.prune(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
