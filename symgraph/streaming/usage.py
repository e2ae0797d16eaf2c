"""Usage counts from a stream of events; equal to the batch result once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.sources.adapter import usage_rows


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Tool events from Parquet files as they arrive in a folder."""
    return usage_rows(spark.readStream.schema(schema).parquet(folder))


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp"))  # a watermark needs an instant; times without a zone are the session's
    windows = timed.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour"))
    return windows.agg(F.count("*").alias("calls"), F.sum("token_reduction").alias("saved")).select(F.col("window.start").alias("hour"), "calls", "saved")
