"""Usage analytics over tool events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import cost_cents


def tool_stats(events: DataFrame) -> DataFrame:
    """Per tool: calls, whole mean latency, tokens saved and delivered, failures."""
    rows = events.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum("execution_time_ms").alias("ms"), F.sum("token_reduction").alias("saved"), F.sum("delivered_token_count").alias("delivered"), F.count_if(~F.col("success")).alias("failures"))
    return rows.select("tool_name", "calls", F.expr("ms div calls").alias("avg_ms"), "saved", "delivered", "failures")


def usage_totals(events: DataFrame) -> DataFrame:
    rows = events.agg(F.count("*").alias("calls"), F.coalesce(F.sum("token_reduction"), F.lit(0)).alias("saved"), F.count_if(~F.col("success")).alias("failures"), F.round(F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)), 4).alias("avg_ms"))
    return rows.withColumn("success_percent", F.when(F.col("calls") == 0, 100.0).otherwise(F.round(100.0 * F.try_divide(F.col("calls") - F.col("failures"), F.col("calls")), 4))).withColumn("cost_cents", F.round(cost_cents(F.col("saved"), F.lit("claude")), 4))


def hourly(events: DataFrame, buckets: int = 24) -> DataFrame:
    """The latest non-empty hours, oldest first."""
    rows = events.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("calls"), F.sum("token_reduction").alias("saved"))
    return rows.orderBy(F.desc("hour")).limit(buckets).select(F.date_format("hour", "MM/dd HH:00").alias("label"), "calls", "saved")


def cache_hit_rate(events: DataFrame) -> DataFrame:
    return events.agg(F.round(F.coalesce(F.avg(F.col("cache_hit").cast("double")) * 100, F.lit(0.0)), 6).alias("percent"))


def recent_errors(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.where(~F.col("success")).orderBy(F.desc("id")).limit(limit).select("id", "tool_name", "execution_time_ms")
