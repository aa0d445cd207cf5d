"""Joins that Spark has no operator for, composed of ones it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str, forward: bool = False) -> DataFrame:
    """left with the `value` of the nearest right row of the key at or before (forward: after) each row's order.

    Both sides are stacked and carried along one window, so cost is one sort of the key's rows and no pairs are made. With equal
    order a right row counts as before; rows of right with equal order are taken in order of value. Null keys match nothing.
    """
    nothing = F.lit(None).cast(right.schema[value].dataType)
    unkeyed = left.where(F.col(key).isNull()).withColumn(value, nothing)  # set aside, so that they gather in no task
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    a = left.withColumns({"_side": F.lit(0 if forward else 1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(F.col(key), F.col(order), F.lit(1 if forward else 0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    at = Window.partitionBy(key).orderBy(*((F.desc(order), F.desc("_side"), F.desc("_v")) if forward else (F.asc(order), F.asc("_side"), F.asc("_v"))))
    found = F.last("_v", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn(value, found).where(F.col("_side") == (0 if forward else 1))
    return out.select(*left.columns, value).unionByName(unkeyed)


def band(left: DataFrame, right: DataFrame, on: Column, left_value: str, right_value: str, width: float, keys: list[str]) -> DataFrame:
    """Pairs of equal keys whose values differ by `width` at most: an equi-join on cells of that width and their neighbours."""
    if width <= 0:
        return left.join(right.withColumnsRenamed({}), [*keys]).where(on & (F.col(left_value) == F.col(right_value)))
    a = left.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(left_value) / width) + i for i in (-1, 0, 1)])))
    b = right.withColumn("_cell", F.floor(F.col(right_value) / width))
    return a.join(b, [*keys, "_cell"]).where(on & (F.abs(F.col(left_value) - F.col(right_value)) <= width)).drop("_cell")


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, changed or same, by a full outer join."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def first_resolving(left: DataFrame, lookup: DataFrame, refs: list[str], key: str, value: str) -> DataFrame:
    """left with the value of the first of its references that lookup knows: one left join per reference, coalesced."""
    out, got = left, []
    for i, ref in enumerate(refs):
        out = out.join(lookup.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(ref) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        got.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*got)).drop(*[f"_v{i}" for i in range(len(refs))])
