"""Sections into units: chapters, greedy packs, split texts and folded remains; and what a unit refers to.

A greedy pack is sequential within its group, so only places and sizes are folded and joined back; all else is windows and joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from clausework.functions import records

# fixed values
CLAUSE_REFERENCE = r"(?i)\b(?:given in|specified in|according to|defined in|listed in|in accordance with|see)\s+(Annex\s+[A-Z]\b|[A-Z]\.\d+(?:\.\d+)*\b|\d+(?:\.\d+){1,5})"
CLAUSE_HEADING = r"(?m)^(?:Annex\s+([A-Z])\b|([A-Z]\.\d+(?:\.\d+)*)\b|(\d+(?:\.\d+){1,5})\b)"
TERM_NAME = r"^\d+(?:\.\d+)*\s+(.{4,60}?)\s*$"
TERMS_HEADING = r"(?i)term|definition|abbreviat|glossary|术语|定义|符号"
LEAST_UNIT, MOST_REFERENCES, EXCERPT, MOST_TERMS, TERM_CHARS = 120, 2, 1200, 4, 240


def chapters(df: DataFrame, by: list[str], order: str, heading: str) -> DataFrame:
    """df with `chapter` (the first number of the heading, null without) and `run`: neighbours of one chapter, or all without a number."""
    w = Window.partitionBy(*by).orderBy(order)
    key = F.substring_index(records.clause_key(F.col(heading)), ".", 1)
    d = df.withColumn("chapter", key)
    new = (~F.col("chapter").eqNullSafe(F.lag("chapter").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return d.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def packs(df: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """df with `pack`, from 1 within each group: pieces in order as long as they fit the budget; a piece above it stands alone."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, order])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pack, held, count, out = 1, 0, 0, []
        for n in pdf["_size"].tolist():
            if count and (n > budget or held + n > budget):
                pack, held, count = pack + 1, 0, 0
            out.append(pack)
            held, count = held + n, count + 1
            if n > budget:
                pack, held, count = pack + 1, 0, 0
        return pdf[[*by, order]].assign(pack=out)

    small = df.select(*by, order, F.col(size).cast("long").alias("_size"))
    return df.join(small.groupBy(*by).applyInPandas(fold, f"{kinds}, pack int"), [*by, order])


@pandas_udf(ArrayType(StringType()))
def _cut(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_lines_cut(t or "", n) for t, n in zip(texts, sizes, strict=True)])


def _lines_cut(text: str, n: int) -> list[str]:
    if len(text) <= n:
        return [text]
    units = [x for line in text.split("\n") for x in ([line] if len(line) <= n else [line[i : i + n] for i in range(0, len(line), n)])]
    out, held = [[]], 0
    for x in units:
        if out[-1] and held + len(x) + 1 > n:
            out.append([])
            held = 0
        out[-1].append(x)
        held += len(x) + 1
    return [t for t in ("\n".join(x) for x in out) if t.strip()]


def cut_text(text: Column, n: int) -> Column:
    """A text above n characters in pieces of whole lines that fit; a longer line is cut hard. Blank pieces are left out."""
    return _cut(text, F.lit(n))


def folded(df: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """df with `unit`, from 1: units below the least size (120, or a quarter of the budget) belong to the one before."""
    least = min(LEAST_UNIT, max(1, budget // 4))
    w = Window.partitionBy(*by).orderBy(order)
    opens = ((F.row_number().over(w) == 1) | (F.col(size) >= least)).cast("int")
    return df.withColumn("_o", opens).withColumn("unit", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def references(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """by, order, clause, excerpt: up to two clauses that a section refers to and another one heads, in the order they are named."""
    head = lambda i: F.regexp_extract_all(F.col(text), F.lit(CLAUSE_HEADING), F.lit(i))
    at = df.select(*by, F.col(order).alias("_to"), F.col(text).alias("_text"), F.posexplode(F.arrays_zip(head(0).alias("h"), head(1).alias("a"), head(2).alias("b"), head(3).alias("c"))).alias("_i", "k"))
    at = at.withColumn("clause", F.coalesce(F.nullif("k.a", F.lit("")), F.nullif("k.b", F.lit("")), F.col("k.c")))
    first = at.groupBy(*by, "clause").agg(F.min_by(F.struct("_to", "_text", "k.h"), F.struct("_to", "_i")).alias("t"))
    named = F.transform(F.regexp_extract_all(F.col(text), F.lit(CLAUSE_REFERENCE), F.lit(1)), lambda x: F.when(F.lower(F.trim(x)).startswith("annex"), F.upper(F.substring_index(F.trim(x), " ", -1))).otherwise(F.trim(x)))
    refs = df.select(*by, order, F.posexplode(F.array_distinct(named)).alias("_n", "clause"))
    hit = refs.join(first, [*by, "clause"]).where(F.col("t._to") != F.col(order))
    hit = hit.withColumn("_r", F.row_number().over(Window.partitionBy(*by, order).orderBy("_n"))).where(F.col("_r") <= MOST_REFERENCES)
    # the excerpt begins where the clause heads a line
    start = F.when(F.startswith(F.col("t._text"), F.col("t.h")), F.lit(1)).otherwise(F.instr(F.col("t._text"), F.concat(F.lit("\n"), F.col("t.h"))) + 1)
    return hit.select(*by, order, "clause", F.substr(F.col("t._text"), start, F.lit(EXCERPT)).alias("excerpt"))


def terms(df: DataFrame, by: list[str], heading: str, path: str, text: str) -> DataFrame:
    """by, ord, term, definition: terms that sections of a terms chapter define, short single words and the chapter's own headings aside."""
    chapter = F.concat_ws(" / ", F.col(path), F.col(heading)).rlike(TERMS_HEADING)
    name = F.trim(F.regexp_extract(F.trim(F.col(heading)), TERM_NAME, 1))
    d = df.where(chapter).withColumn("term", name).where("term <> ''")
    return d.where(((F.length("term") >= 8) | F.contains("term", F.lit(" "))) & ~F.col("term").rlike(TERMS_HEADING)).select(*by, "ord", "term", F.substring(F.col(text), 1, TERM_CHARS).alias("definition"))


def attached_terms(df: DataFrame, defined: DataFrame, by: list[str], order: str, path: str, text: str) -> DataFrame:
    """by, order, term, definition: up to four terms that a section outside the terms chapter holds, in the order they are defined.

    Sections and terms meet on the first four characters of a term, so only those that have them are searched.
    """
    body = df.where(~F.coalesce(F.concat_ws(" / ", F.col(path)), F.lit("")).rlike(TERMS_HEADING)).select(*by, F.col(order).alias("_o"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_b"))
    # cut into characters once, so that the keys of a long text cost its length
    grams = F.transform("_c", lambda x, i: F.concat_ws("", x, F.get("_c", i + 1), F.get("_c", i + 2), F.get("_c", i + 3)))
    keyed = body.withColumn("_c", F.split("_b", "")).withColumn("_k", F.explode(F.array_distinct(grams))).drop("_c")
    t = defined.select(*by, F.col("ord").alias("_t"), "term", "definition", F.substring(F.lower("term"), 1, 4).alias("_k"))
    hit = keyed.join(t, [*by, "_k"]).where(F.contains("_b", F.lower("term")))
    i = F.row_number().over(Window.partitionBy(*by, "_o").orderBy("_t"))
    return hit.withColumn("_i", i).where(F.col("_i") <= MOST_TERMS).select(*by, F.col("_o").alias(order), "term", "definition")


def sheet_links(keys: DataFrame, by: list[str]) -> DataFrame:
    """by, status, mergeable of workbooks from the keys of their tables (by, sheet, table_id, key; key null for tables without).

    single_sheet_table: fewer than two tables or sheets with keys; key_conflict: two tables of a sheet share a key; key_missing: no key of
    one sheet is on another; linked: some key is.
    """
    k = keys.where("key is not null").distinct()
    size = k.groupBy(*by).agg(F.count_distinct("table_id").alias("t"), F.count_distinct("sheet").alias("s"))
    clash = k.groupBy(*by, "sheet", "key").agg(F.count_distinct("table_id").alias("n")).groupBy(*by).agg(F.max("n").alias("clash"))
    shared = k.groupBy(*by, "key").agg(F.count_distinct("sheet").alias("n")).groupBy(*by).agg(F.max("n").alias("shared"))
    out = keys.select(*by).distinct().join(size, by, "left").join(clash, by, "left").join(shared, by, "left")
    status = F.when((F.coalesce("t", F.lit(0)) < 2) | (F.coalesce("s", F.lit(0)) < 2), "single_sheet_table").when(F.col("clash") > 1, "key_conflict").when(F.col("shared") > 1, "linked").otherwise("key_missing")
    return out.select(*by, status.alias("status")).withColumn("mergeable", ~F.col("status").isin("key_conflict", "key_missing"))
