"""Order-sensitive operators over explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, name: str, by: list[str], order: list[str]) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sessions(df: DataFrame, time: str, gap_seconds: int, by: list[str], order: list[str], name: str = "session") -> DataFrame:
    """Numbers runs of rows that are at most the gap apart, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def within_budget(df: DataFrame, cost: str, budget: int, by: list[str], order: list[Column]) -> DataFrame:
    """The longest prefix of each group whose cost fits; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", spent).withColumn("_i", F.row_number().over(w)).where((F.col("_i") == 1) | (F.col("spent") <= budget)).drop("_i")


def last_decision(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of highest order of each key; a grouped maximum, which combines before it shuffles."""
    rest = [c for c in events.columns if c not in by]
    picked = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return events.groupBy(*by).agg(picked).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def page(df: DataFrame, by: list[str], order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of each group with the number of all its rows; limits from 1 to 500, offsets from 0."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumns({"_i": i, "total": F.count("*").over(Window.partitionBy(*by))})
    return rows.where((F.col("_i") > offset) & (F.col("_i") <= offset + limit)).drop("_i")
