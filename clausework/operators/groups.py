"""Grouping, counting and sequence operators that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of lowest order of each key; a grouped minimum, which combines before it shuffles. Ties in the order go to any of the rows."""
    rest = [c for c in df.columns if c not in by]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*by).agg(picked).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def seeded_counts(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, n: rows of each of the stated values, 0 for those that do not occur; other values are left out."""
    found = df.where(F.col(key).isin(values)).groupBy(key).agg(F.count("*").alias("n"))
    seeds = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return seeds.join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def counter_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, delta of two counter snapshots; a key that one lacks counts 0 there, and unchanged keys are left out."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    delta = F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))
    return a.join(b, key, "full_outer").select(key, delta.alias("delta")).where("delta <> 0")


def stride_sample(df: DataFrame, rate: float, by: list[str], order: list[str]) -> DataFrame:
    """Evenly spaced rows of each group in the stated order, `rate` of them but one at least, from the first on; the same rows on every run."""
    at, n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumns({"_at": at, "_n": n}).withColumn("_goal", F.greatest(F.lit(1), F.bround(F.col("_n") * rate)).cast("long"))
    # row _at is the i-th pick where floor(i * n / goal) is _at; i is _at * goal / n, rounded
    near = F.floor(F.col("_at") * F.col("_goal") / F.col("_n"))
    picked = lambda i: (i >= 0) & (i < F.col("_goal")) & (F.floor(i * (F.col("_n") / F.col("_goal"))) == F.col("_at"))
    return rows.where((F.col("_goal") >= F.col("_n")) | picked(near - 1) | picked(near) | picked(near + 1)).drop("_at", "_n", "_goal")


def occurrence_suffix(df: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """Blank names become column_<n>; the k-th repeat of a name within its group gets the suffix _k, from the second on."""
    named = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    named = named.withColumn(name, F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.concat(F.lit("column_"), "_n")).otherwise(F.col(name)))
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return named.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 1, F.concat(name, F.lit("_"), "_k")).otherwise(F.col(name))).drop("_n", "_k")


def islands(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Runs of consecutive rows with one value: by, value, island (from 1), n."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, value, "island").agg(F.count("*").alias("n"))


def shared_keys(df: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """Keys that several members use: key, members, values_differ; distinct by two combinable aggregations."""
    each = df.groupBy(key, member).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = each.groupBy(key).agg(F.count(member).alias("members"), (F.min("_lo") < F.max("_hi")).alias("values_differ"))
    return out.where("members > 1")


def valid_prefix(df: DataFrame, sequence: str, by: list[str]) -> DataFrame:
    """by, n, valid: the rows of each log, and how many stand before the first gap or repeat of its sequence from 1."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(sequence))
    rows = df.withColumn("_at", at)
    broken = F.min(F.when(F.col(sequence) != F.col("_at"), F.col("_at")))
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("n"), F.coalesce(broken - 1, n).cast("long").alias("valid"))


def two_sided(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: hits, truths, found, recall and precision of distinct keys, from one full outer join; 0 for empty sides."""
    a, b = truth.select(key).distinct().withColumn("_t", F.lit(1)), found.select(key).distinct().withColumn("_f", F.lit(1))
    both = a.join(b, key, "full_outer")
    out = both.agg(F.count(F.col("_t") + F.col("_f")).alias("hits"), F.count("_t").alias("truths"), F.count("_f").alias("found"))
    share = lambda c: F.when(F.col(c) > 0, F.round(F.col("hits") / F.col(c), 4)).otherwise(0.0)
    return out.withColumns({"recall": share("truths"), "precision": share("found")})


def cascade(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for holds, name in rules[1:]:
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit(otherwise))
