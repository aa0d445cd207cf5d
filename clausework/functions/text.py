"""Column expressions over text: normal forms, signals, classes and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in words])


def ints(text: Column) -> Column:
    """Distinct integers in the text as sorted strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


def ratio(a: Column, b: Column, empty: float | None) -> Column:
    """a / b to four places; `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(F.round(a / b, 4))
