"""Structured Streaming over the event table: an extension beside the pipeline's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The parquet folder as a stream, event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once; ids are remembered until the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows."""
    agg = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def retry_state(attempts: DataFrame) -> DataFrame:
    """Attempts with the number of failures since the last success of the user: running state as a window."""
    return attempts.selectExpr("*", "count_if(failed) over (partition by user_id, run order by ts, event_id) as failures").drop("run")
