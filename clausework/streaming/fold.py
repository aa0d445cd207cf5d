"""The event fold as a stream: the latest decision per key, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running last-decision-wins of a stream or a table; write with outputMode('update') or 'complete'."""
    return events.groupBy(key).agg(F.max(F.struct(order, value)).alias("_r")).select(key, F.col(f"_r.{value}").alias(value), F.col(f"_r.{order}").alias(order))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows; rows later than `late` are dropped by the watermark of a stream."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width), *by).agg(F.count("*").alias("n"))
