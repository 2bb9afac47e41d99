"""Events as a stream: each id once, counted by window and by session. An extension: batch queries say the same of a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType().add("event_id", "long").add("ts", T.TimestampNTZType()).add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")


def source(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files under a path; the schema is declared."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark; state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def by_window(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
