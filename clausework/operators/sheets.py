"""Regions of spreadsheets: connected cells, declared tables, merged ranges within them, and how their borders may fail.

cells: by (the sheet), r, c, text; filled ones only matter. Connected regions are found by propagating the smallest cell over neighbours;
each round is a grouped minimum, rows and columns of one sheet are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.operators import tables
from clausework.sources.store import written


def inside(cells: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """cells that lie in a region (r1, c1, r2, c2), once."""
    at = regions.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2"))).select(*by, "r", "c").distinct()
    return cells.join(at, [*by, "r", "c"], "left_semi")


def connected(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, comp: filled cells and the component they belong to; cells that touch, at a corner too, belong together.

    Runs along a row are joined first by a window, so the rounds that follow grow with the shape of a region and not with its width; a
    run then takes the smallest label of the runs that it touches, and labels are followed to their own label in each round.
    """
    filled = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    w = Window.partitionBy(*by, "r").orderBy("c")
    runs = filled.withColumn("_new", (F.coalesce(F.col("c") - F.lag("c").over(w), F.lit(2)) > 1).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.groupBy(*by, "r", "_run").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).withColumn("_me", F.struct(F.col("r").alias("i"), F.col("_a").alias("j"))), "runs")
    x = runs.select(*by, F.col("_me").alias("_x"), F.col("_a").alias("_xa"), F.col("_b").alias("_xb"), F.explode(F.array(F.col("r") - 1, F.col("r") + 1)).alias("r"))
    edges = written(x.join(runs, [*by, "r"]).where((F.col("_xa") <= F.col("_b") + 1) & (F.col("_a") <= F.col("_xb") + 1)).select(*by, "_x", F.col("_me").alias("_y")), "edges")
    label = written(runs.select(*by, F.col("_me").alias("_x"), F.col("_me").alias("_l")), "labels")
    while True:
        near = edges.join(label.select(*by, F.col("_x").alias("_y"), F.col("_l").alias("_yl")), [*by, "_y"]).groupBy(*by, "_x").agg(F.min("_yl").alias("_m"))
        low = written(label.join(near, [*by, "_x"], "left").select(*by, "_x", "_l", F.least("_l", F.coalesce("_m", "_l")).alias("_n")), "labels")
        # what a run learns is told to its old label as well, and labels point on to their own labels
        told = low.groupBy(*by, F.col("_l").alias("_x")).agg(F.min("_n").alias("_told"))
        after = written(low.join(told, [*by, "_x"], "left").select(*by, "_x", "_l", F.least("_n", F.coalesce("_told", "_n")).alias("_n")), "labels")
        jump = after.select(*by, F.col("_x").alias("_n"), F.col("_n").alias("_far"))
        after = written(after.join(jump, [*by, "_n"], "left").select(*by, "_x", "_l", F.least("_n", F.coalesce("_far", "_n")).alias("_n")), "labels")
        done = after.where("_n <> _l").isEmpty()
        label = after.select(*by, "_x", F.col("_n").alias("_l"))
        if done:
            break
    named = runs.join(label.withColumnRenamed("_x", "_me"), [*by, "_me"]).select(*by, "r", "_a", "_b", F.col("_l").alias("comp"))
    return filled.join(named, [*by, "r"]).where("c between _a and _b").select(*by, "r", "c", "comp")


def regions(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, r1, c1, r2, c2: the rectangles around connected cells."""
    return connected(cells, by).groupBy(*by, "comp").agg(F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2")).drop("comp")


def declared(named: DataFrame, by: list[str], last_row: int) -> DataFrame:
    """by, r1, c1, r2, c2, header_rows: declared tables (ref as B2:D9, header_count) cut at the last row read; ones below it are left out."""
    part = lambda i: F.regexp_extract("ref", r"^\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)$", i)
    number = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))
    rows = F.greatest(F.lit(0), F.coalesce("header_count", F.lit(1)))
    head = F.when(rows > 0, F.sequence(F.lit(1), F.greatest(rows, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    d = named.where(part(1) != "").select(*by, part(2).cast("int").alias("r1"), number(part(1)).alias("c1"), F.least(part(4).cast("int"), F.lit(last_row)).alias("r2"), number(part(3)).alias("c2"), head.alias("header_rows"))
    return d.where("r2 >= r1")


def clipped(ranges: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Ranges cut to the regions that they touch, in the coordinates of the region (region: r1, c1)."""
    a = ranges.select(*by, *(F.col(x).alias(f"m{x}") for x in ("r1", "c1", "r2", "c2")))
    j = a.join(found, by).where("mr2 >= r1 and mr1 <= r2 and mc2 >= c1 and mc1 <= c2")
    return j.select(*by, F.struct("r1", "c1").alias("region"), (F.greatest("mr1", "r1") - F.col("r1") + 1).alias("r1"), (F.greatest("mc1", "c1") - F.col("c1") + 1).alias("c1"), (F.least("mr2", "r2") - F.col("r1") + 1).alias("r2"), (F.least("mc2", "c2") - F.col("c1") + 1).alias("c2"))


def filled(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """cells where those of a range have the text of its first cell; ranges that cover a text of their own are left alone."""
    ok = tables.range_conflicts(cells, ranges, by).where("not conflict").drop("conflict")
    over = tables.covered(ok, by).select(*by, "r", "c", "r1", "c1")
    first = cells.select(*by, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("text").alias("_t"))
    fill = over.join(first, [*by, "r1", "c1"], "left").select(*by, "r", "c", F.coalesce("_t", F.lit("")).alias("_fill"))
    out = cells.join(fill, [*by, "r", "c"], "full_outer")
    return out.select(*by, "r", "c", tables.clean_cell(F.coalesce("_fill", "text")).alias("text"))


def matrices(cells: DataFrame, found: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, region, r, c, text: every cell of each region in its own coordinates, merged ones filled, missing ones empty."""
    grid = found.withColumns({"region": F.struct("r1", "c1")}).withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2")))
    grid = grid.join(filled(cells, ranges, by), [*by, "r", "c"], "left")
    return grid.select(*by, "region", (F.col("r") - F.col("r1") + 1).alias("r"), (F.col("c") - F.col("c1") + 1).alias("c"), F.coalesce("text", F.lit("")).alias("text"))


def border_conflicts(found: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, code, n: places that two regions share, and ranges that lie in several regions or only partly in one."""
    at = found.select(*by, F.struct("r1", "c1").alias("reg"), "r1", "c1", "r2", "c2").distinct()
    cells = at.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2"))).select(*by, "reg", "r1", "c1", "r2", "c2", "r", "c")
    twice = cells.groupBy(*by, "r", "c").agg(F.count("*").alias("k")).where("k > 1").groupBy(*by).agg(F.lit("region_overlap").alias("code"), F.lit(1).cast("long").alias("n"))
    m = tables.normal_ranges(ranges).select(*by, *(F.col(x).alias(f"m{x}") for x in ("r1", "c1", "r2", "c2")))
    spread = m.withColumn("r", F.explode(F.sequence("mr1", "mr2"))).withColumn("c", F.explode(F.sequence("mc1", "mc2"))).join(cells, [*by, "r", "c"])
    whole = F.bool_or((F.col("r1") <= F.col("mr1")) & (F.col("c1") <= F.col("mc1")) & (F.col("r2") >= F.col("mr2")) & (F.col("c2") >= F.col("mc2")))
    cut = spread.groupBy(*by, "mr1", "mc1", "mr2", "mc2").agg(F.count_distinct("reg", "r2", "c2").alias("k"), whole.alias("w")).where("k > 1 or not w")
    return twice.unionByName(cut.groupBy(*by).agg(F.lit("region_splits_merge").alias("code"), F.count("*").alias("n")))


def uncached(cells: DataFrame, by: list[str], columns: int) -> DataFrame:
    """by, r, c of formulas without a stored value, within the columns read. cells: kind (f for formulas), text."""
    return cells.where((F.col("kind") == "f") & (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.col("c") <= columns)).select(*by, "r", "c")
