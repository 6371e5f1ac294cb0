"""Event streams: tumbling windows and gap sessions with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream; the schema comes from what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums in fixed windows; also works on a batch."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_ts", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap without events; also works on a batch."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
