"""Queries over sheets, one for each part, drawn from eight pictures; the SQL states the regions of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import sheets
from clausework.sources import office, office_sinks

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: Rows of a sheet, a letter for a filled cell: a block, two blocks, corners that touch, a ring, a spiral, a comb, nothing, one cell.
PICTURES = (
    ("aaa", "aaa", "..."),
    ("aa...bb", "aa...bb", ".......", "c......"),
    ("a....", ".a...", "..a..", "....b"),
    ("aaaa", "a..a", "a..a", "aaaa"),
    ("aaaaaaa", "......a", "aaaaa.a", "a...a.a", "a.aaa.a", "a.....a", "aaaaaaa"),
    ("a.a.a.a", "a.a.a.a", "aaaaaaa"),
    ("...",),
    ("..", ".a"),
)
#: Regions by picture: r1, c1, r2, c2.
FOUND = (
    (0, 1, 1, 2, 3), (1, 1, 1, 2, 2), (1, 1, 6, 2, 7), (1, 4, 1, 4, 1), (2, 1, 1, 3, 3), (2, 4, 5, 4, 5), (3, 1, 1, 4, 4), (4, 1, 1, 7, 7), (5, 1, 1, 3, 7), (7, 2, 2, 2, 2),
)
RANGES = {0: ((1, 1, 1, 2), (2, 3, 3, 3)), 1: ((1, 2, 1, 6), (3, 3, 3, 4)), 3: ((1, 1, 4, 4),)}
_VALUES = ", ".join(map(str, FOUND))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, r, c, x) for k, p in enumerate(PICTURES) for r, line in enumerate(p, 1) for c, x in enumerate(line, 1) if x != "."]
    pictures = spark.createDataFrame(rows, "k long, r int, c int, text string")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("t"), (F.col("p_partkey") % 8).alias("k")).join(F.broadcast(pictures), "k").select("t", "r", "c", "text")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([(k, *x) for k, xs in RANGES.items() for x in xs], "k long, r1 int, c1 int, r2 int, c2 int")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("t"), (F.col("p_partkey") % 8).alias("k")).join(F.broadcast(r), "k").drop("k")


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_query(f"SELECT p_partkey AS t, CAST(r1 AS BIGINT) AS r1, CAST(c1 AS BIGINT) AS c1, CAST(r2 AS BIGINT) AS r2, CAST(c2 AS BIGINT) AS c2 FROM part JOIN (VALUES {_VALUES}) v(k, r1, c1, r2, c2) ON k = p_partkey % 8")
def sheet_regions(spark, d):
    return sheets.regions(_cells(spark, d), ["t"])


@_query("SELECT p_partkey AS t, r1, c1, r2, c2, h FROM part JOIN (VALUES (0, 2, 2, 9, 4, '1'), (1, 1, 27, 20, 30, '1,2'), (2, 5, 1, 6, 1, '')) v(k, r1, c1, r2, c2, h) ON k = p_partkey % 8")
def declared_tables(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("t"), (F.col("p_partkey") % 8).alias("k"))
    ref = F.when(F.col("k") == 0, "B2:D9").when(F.col("k") == 1, "$AA$1:AD99").when(F.col("k") == 2, "A5:A6").when(F.col("k") == 3, "B30:C40").otherwise("broken")
    named = p.select("t", ref.alias("ref"), F.when(F.col("k") == 1, 2).when(F.col("k") == 2, 0).alias("header_count"))
    return sheets.declared(named, ["t"], 20).withColumn("h", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",")).drop("header_rows")


@_query("SELECT p_partkey AS t, CAST(g AS VARCHAR) AS region, CAST(r1 AS BIGINT) AS r1, CAST(c1 AS BIGINT) AS c1, CAST(r2 AS BIGINT) AS r2, CAST(c2 AS BIGINT) AS c2 FROM part JOIN (VALUES (0, '1,1', 1, 1, 1, 2), (0, '1,1', 2, 3, 2, 3), (1, '1,1', 1, 2, 1, 2), (1, '1,6', 1, 1, 1, 1), (3, '1,1', 1, 1, 4, 4)) v(k, g, r1, c1, r2, c2) ON k = p_partkey % 8")
def clipped_ranges(spark, d):
    out = sheets.clipped(_ranges(spark, d), sheets.regions(_cells(spark, d), ["t"]), ["t"])
    return out.select("t", F.concat_ws(",", F.col("region.r1").cast("string"), F.col("region.c1").cast("string")).alias("region"), "r1", "c1", "r2", "c2")


@_query("SELECT p_partkey AS t, code, CAST(n AS BIGINT) AS n FROM part JOIN (VALUES (0, 'region_splits_merge', 1), (1, 'region_splits_merge', 1)) v(k, code, n) ON k = p_partkey % 8")
def region_borders(spark, d):
    return sheets.border_conflicts(sheets.regions(_cells(spark, d), ["t"]), _ranges(spark, d), ["t"])


@_query("SELECT p_partkey AS t, CAST(n AS BIGINT) AS n, CAST(f AS BIGINT) AS f FROM part JOIN (VALUES (0, 6, 6), (1, 9, 9), (2, 10, 4), (3, 16, 16), (4, 49, 31), (5, 21, 15), (7, 1, 1)) v(k, n, f) ON k = p_partkey % 8")
def region_matrices(spark, d):
    c = _cells(spark, d)
    m = sheets.matrices(c, sheets.regions(c, ["t"]), _ranges(spark, d).withColumns({x: F.col(x).cast("long") for x in ("r1", "c1", "r2", "c2")}), ["t"])
    return m.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("f"))


@_query("SELECT l_orderkey AS t, l_linenumber AS r, CAST(l_suppkey AS INT) AS c FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_suppkey <= 5")
def uncached_formulas(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    cells = l.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r"), F.col("l_suppkey").cast("int").alias("c"), F.when(F.col("l_returnflag") == "A", "f").otherwise("n").alias("kind"), F.when(F.col("l_linestatus") == "F", " ").otherwise("1").alias("text"))
    return sheets.uncached(cells, ["t"], 5)


@_query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'x' END AS number, CASE WHEN CAST(ts AS TIME) = TIME '00:00:00' THEN strftime(ts, '%Y-%m-%d') WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS time, CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag FROM events")
def typed_cells(spark, d):
    from clausework.functions import scalars

    e = spark.read.parquet(f"{d}/events.parquet")
    number = scalars.cell_text(F.when(F.col("event_id") % 5 != 0, F.col("value")), "double")
    return e.select("event_id", F.when((F.col("event_id") % 5 != 0) & (F.col("value") != F.floor("value")), "x").otherwise(number).alias("number"), scalars.cell_text(F.col("ts"), "timestamp").alias("time"), scalars.cell_text(F.col("event_id") % 2 == 0, "boolean").alias("flag"))


# --- sinks, read back by the scans


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")

_BOOK = "SELECT r_name || '.xlsx' AS path, n_name AS sheet, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@_query(f"""SELECT path, sheet, r, 1::BIGINT AS c, '00' || c_custkey AS text FROM ({_BOOK}) UNION ALL SELECT path, sheet, r, 2, '=<' || c_name || '>' FROM ({_BOOK}) WHERE c_custkey % 3 <> 0
UNION ALL SELECT path, sheet, r, 3, c_mktsegment || ' & "co"' FROM ({_BOOK})""")
def written_workbooks(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = F.array(F.concat(F.lit("00"), "c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("=<"), "c_name", F.lit(">"))), F.concat("c_mktsegment", F.lit(' & "co"')))
    rows = c.select(F.concat("r_name", F.lit(".xlsx")).alias("path"), F.col("n_name").alias("sheet"), F.col("c_custkey").alias("ord"), cells.alias("cells"))
    return office.xlsx_cells(office.xlsx(office_sinks.workbooks(rows)))[0].select("path", "sheet", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text")


@_query("""WITH n AS (SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT c_nationkey, string_agg(c_custkey || '|' || c_mktsegment, ';' ORDER BY c_custkey) AS rows FROM customer GROUP BY 1),
u AS (SELECT r_name AS path, n_name AS name, 1 AS z, 'paragraph' AS kind, 'heading 2' AS style, n_name AS text, '' AS rows FROM n UNION ALL SELECT r_name, n_name, 2, 'table', NULL, NULL, t.rows FROM n JOIN t ON c_nationkey = n_nationkey)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY name, z) AS ord, kind, style, text, rows FROM u""")
def written_documents(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment")))
    t = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.transform(lines, lambda x: F.array(x["c_custkey"].cast("string"), x["c_mktsegment"])).alias("rows"))
    heads = n.select(F.col("r_name").alias("path"), F.concat("n_name", F.lit(" 1")).alias("ord"), F.lit("paragraph").alias("kind"), F.lit("heading 2").alias("style"), F.col("n_name").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))
    tables_ = n.join(t, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", F.concat("n_name", F.lit(" 2")), F.lit("table"), F.lit(None), F.lit(None), "rows")
    out = office.docx(office_sinks.documents(heads.union(tables_)))
    return out.select("path", F.col("ord").cast("long").alias("ord"), "kind", "style", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))
