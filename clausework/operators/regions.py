"""Regions of a document from its headings: where the body starts, and what a tender section is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records, rules, tender

# fixed values
MAJOR_HEADINGS = ("scope", "normative references", "terms and definitions", "architecture", "communication profile", "communication profiles", "security", "bibliography", "figures", "tables")


def _order(by: str) -> Window:
    return Window.partitionBy(by).orderBy("ord")


def document_regions(blocks: DataFrame, by: str, start: str = "scope") -> DataFrame:
    """blocks (by, ord, kind, text, section_path) with region: body from the last start heading in the first 60 % of the blocks (else the first
    such heading, else the first block), before it preface, introduction, table_of_contents or front_matter."""
    title = records.plain_title(F.col("text"))
    bare = F.regexp_replace(title, r"^\d+(?:\.\d+)*[.)]?\s+", "")
    b = blocks.withColumn("_i", F.row_number().over(_order(by)) - 1).withColumn("_t", title).withColumn("_head", F.col("kind") == "heading")
    opens = F.col("_head") & ((F.col("_t") == start) | (bare == start))
    n = b.groupBy(by).agg(F.floor(F.count("*") * 0.6).alias("_cut"))
    marks = b.join(n, by).groupBy(by).agg(
        F.max(F.when(opens & (F.col("_i") <= F.col("_cut")), F.col("_i"))).alias("_early"),
        F.min(F.when(opens, F.col("_i"))).alias("_any"),
        F.min(F.when(F.col("_head") & (F.col("_t") == "preface"), F.col("_i"))).alias("_pre"),
        F.min(F.when(F.col("_head") & (F.col("_t") == "introduction"), F.col("_i"))).alias("_intro"),
    )
    listed = F.exists(F.coalesce("section_path", F.array().cast("array<string>")), lambda p: records.plain_title(p).isin("tables", "figures"))
    region = (
        F.when(F.col("_i") >= F.coalesce("_early", "_any", F.lit(0)), "body")
        .when(F.col("_i") >= F.col("_pre"), "preface")
        .when(F.col("_i") >= F.col("_intro"), "introduction")
        .when(listed, "table_of_contents")
        .otherwise("front_matter")
    )
    return b.join(marks, by).withColumn("region", region).select(*blocks.columns, "region")


def tender_regions(blocks: DataFrame, by: str) -> DataFrame:
    """blocks with tender_region, carried on from the last heading that tells one, and doc_region of the headings that do."""
    own = F.when(F.col("kind") == "heading", tender.region_of_heading(F.col("text")))
    b = blocks.withColumn("_own", own)
    carried = F.last("_own", True).over(_order(by).rowsBetween(Window.unboundedPreceding, 0))
    doc = F.when(F.col("_own") == "tender_technical", "body").when(F.col("_own").isNotNull(), "non_product_reference")
    return b.withColumns({"tender_region": carried, "doc_region": doc}).drop("_own")


def captions(blocks: DataFrame, by: str) -> DataFrame:
    """by, ord, title of each table: the last caption before it, else Table and its number. A table uses its caption up, and a text of more
    than 120 characters that is no heading and no noise forgets it."""
    is_table, v = F.col("kind") == "table", F.coalesce("text", F.lit(""))
    w = _order(by)
    forgets = is_table | ((F.col("kind") != "heading") & ~rules.is_noise(v) & (F.length(v) > 120))
    event = F.when(~is_table & rules.is_caption(v), v).when(forgets, "")
    b = blocks.withColumn("_e", event).withColumn("_n", F.sum(is_table.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_c", F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(is_table)
    return b.select(by, "ord", F.coalesce(F.nullif("_c", F.lit("")), F.concat(F.lit("Table "), F.col("_n").cast("string"))).alias("title"))


def matrix_signal(clauses: DataFrame, rows: DataFrame, by: str, least: int = 2) -> DataFrame:
    """by, row_count, fired: table rows in the blocks of a clause (by, block_ids; rows: block_id)."""
    n = rows.groupBy("block_id").agg(F.count("*").alias("n"))
    c = clauses.select(by, F.explode_outer(F.array_distinct("block_ids")).alias("block_id")).join(n, "block_id", "left").groupBy(by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
    return c.withColumn("fired", F.col("row_count") >= least)


def heading_of(text: Column, style: Column, is_list: Column) -> Column:
    """(level, title) of a heading: by its style, a major heading, a number, or as a short list paragraph; null for others."""
    v = F.coalesce(text, F.lit(""))
    low = F.lower(F.coalesce(style, F.lit("")))
    styled = F.regexp_extract(low, r"heading\s+(\d+)", 1)
    pair = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    number, rest = F.regexp_extract(v, rules.NUMBERED, 1), F.trim(F.regexp_extract(v, rules.NUMBERED, 2))
    level = rules.heading_level(v)
    big = (number != "") & ~F.contains(number, F.lit(".")) & (F.coalesce(number.try_cast("long"), F.lit(99)) > 40)
    short = (low == "list paragraph") & ~F.coalesce(is_list, F.lit(False)) & (F.length(v) <= 80) & ~F.endswith(v, F.lit(".")) & ~rules.is_caption(v) & v.rlike("[A-Za-z]")
    return (
        F.when((v == "") | rules.is_noise(v), None)
        .when(styled != "", pair(F.least(styled.cast("int"), F.lit(6)), v))
        .when(F.regexp_replace(F.lower(F.trim(v)), ":+$", "").isin(*MAJOR_HEADINGS), pair(F.lit(1), v))
        .when(big, None)
        .when(level.isNotNull(), pair(level, F.concat_ws(" ", number, rest)))
        .when(short, pair(F.lit(2), v))
    )
