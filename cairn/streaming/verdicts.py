"""Streaming forms of the incremental operators: windowed counts with late data, and the latest verdict per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) in tumbling windows; rows later than the watermark are dropped."""
    held = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def latest(events: DataFrame, key: list[str]) -> DataFrame:
    """The last event of each key by (ts, event_id): the batch and the streaming (complete mode) form are one."""
    last = F.struct("ts", "event_id")
    return events.groupBy(*key).agg(F.max_by("value", last).alias("value"), F.max("ts").alias("ts"))


def sink_latest(spark: SparkSession, batch: DataFrame, store: str, key: list[str]) -> None:
    """foreachBatch body: merges a batch into the store of latest rows; safe to run again for the same batch."""
    from cairn.operators.fixpoint import cut

    new = batch.select(*key, "ts", "event_id", "value")
    try:
        new = spark.read.parquet(store).unionByName(new)
    except Exception as e:  # the store's first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    last = F.struct("ts", "event_id", "value")
    merged = new.groupBy(*key).agg(F.max(last).alias("m")).select(*key, "m.ts", "m.event_id", "m.value")
    cut(merged).write.mode("overwrite").parquet(store)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drains a bounded stream into an in-memory table, for tests and small inputs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
