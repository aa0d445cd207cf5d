"""Sentences of a text: where they end, and how many of them oblige."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import rules, scalars

# fixed values
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "fig.", "no.", "dr.", "mr.", "mrs.", "ms.", "prof.", "vs.", "approx.", "incl.", "excl.", "cf.", "st.")
CONDITION_START = r"(?i)^(if|when|where|in case|unless)\b"

_WORD = r"[\p{L}\p{N}]"
#: A stop ends a sentence unless letters or digits touch it on both sides or it ends an abbreviation; closing signs and blanks go with it.
_STOP = rf"\.(?:(?<!{_WORD}\.)|(?!{_WORD}))" + "".join(rf"(?<!(?i:{a.replace('.', '[.]')}))" for a in ABBREVIATIONS)
_END = rf"(?:[!?;。！？；\n\r]|{_STOP})[.!?;。！？；:]*\s*"
_CUT = "\x1f"


def parts(text: Column) -> Column:
    """The text in pieces that end with a sentence; joined they give the text. Pieces without a letter or digit go to a neighbour."""
    v = F.coalesce(text, F.lit(""))
    raw = F.filter(F.split(F.regexp_replace(v, f"({_END})", f"$1{_CUT}"), _CUT, -1), lambda x: x != "")

    def add(acc: Column, x: Column) -> Column:
        done, n = acc["done"], F.size(acc["done"])
        own = F.struct(F.lit("").alias("lead"), F.concat(done, F.array(F.concat(acc["lead"], x))).alias("done"))
        grown = F.struct(acc["lead"].alias("lead"), F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(done, n - 1), x))).alias("done"))
        kept = F.struct(F.concat(acc["lead"], x).alias("lead"), done.alias("done"))
        return F.when(x.rlike(_WORD), own).when(n > 0, grown).otherwise(kept)

    start = F.struct(F.lit("").alias("lead"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(raw, start, add, lambda acc: F.when(F.size(acc["done"]) > 0, acc["done"]).when(v != "", F.array(v)).otherwise(F.array().cast("array<string>")))


def spans(text: Column) -> Column:
    """(start, end) of each piece, 0-based, end exclusive."""
    p = parts(text)
    ends = lambda i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(p, lambda x, i: F.struct((ends(i) - F.length(x)).alias("start"), ends(i).alias("end")))


def normative_count(text: Column) -> Column:
    """Different sentences that oblige, blanks aside."""
    keys = F.transform(F.filter(parts(text), rules.is_normative), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.size(F.array_distinct(keys))


def fragments(text: Column) -> Column:
    """Lines and sentences that blanks follow; where that is one, the sentences of spans()."""
    v = F.trim(F.coalesce(text, F.lit("")))
    cut = F.filter(F.transform(F.split(v, r"(?<=[.!?;。！？；])\s+|[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    fine = F.filter(F.transform(parts(v), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(cut) > 1, cut).when(F.size(fine) > 0, fine).otherwise(cut)


def of_paragraph(text: Column) -> Column:
    """Cleaned sentences, cut at blanks after . ; ! or ?"""
    c = scalars.clean(text)
    return F.filter(F.transform(F.split(c, r"(?<=[.;!?])\s+"), scalars.clean), lambda x: x != "")


def contexts(text: Column) -> Column:
    """Each sentence of a paragraph with the one before."""
    s = of_paragraph(text)
    return F.transform(s, lambda x, i: F.struct(x.alias("sentence"), F.when(i > 0, F.get(s, i - 1)).alias("prev")))


def condition(prev: Column) -> Column:
    """The sentence before, where it opens with a condition and is no requirement itself."""
    return F.when(prev.rlike(CONDITION_START) & ~rules.is_atomic_like(prev), prev)
