"""Queries over small tables, one for each part, of eight shapes; the SQL states what each shape must come out as."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import records
from clausework.operators import tables
from clausework.sources.store import written

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_DUTY = "The device shall keep every record of kind {z} for at least {z} days."
#: Shapes by part number modulo 8: parameter, mapping matrix, prose grid, other, merged title and group, clause rows, lettered headers, no header.
MATRICES = (
    (("Parameter", "Requirement value", "Unit", "Note"), ("Supply", "{z} V", "V", ""), ("Battery", "Service life: 15 years", "", "as sold"), ("Case", "", "", ""), ("Lid", "The lid must close. The lid shall lock.", "mm", ""), ("Maker: PO 7", "", "", "")),
    (("Object", "GET", "SET", "Remarks"), ("Clock", "x", "X", "old"), ("Meter {z}", "x", "-", "kept"), ("", "yes", "X", ""), ("Relay", "x", "", "It is kept in a box here."), ("Log", "-", "x", "required")),
    (("Topic", "Duty A", "Duty B", "Duty C"), ("Time", _DUTY, _DUTY, "none"), ("Space", _DUTY, _DUTY, "This text only tells how the box is made."), ("The box must fit", _DUTY, _DUTY, ""), ("Last", _DUTY, _DUTY, "Color: RAL 7035 here"), ("", "", "", "")),
    (("Name", "Place", "Owner", "Color"), ("Box", "hall", "Ann", "red"), ("Lid", "hall", "Bob", "must be blue"), ("Jar", "", "", ""), ("Status: AB 1", "x", "Eve", "plain"), ("This row is a plain remark only.", "", "", "")),
    (("Table of things {z}", "", "", ""), ("Name", "Class", "Mode 1", "Other"), ("Box", "1", "X", "a"), ("Group one", "", "", ""), ("Jar", "2", "X", "It must hold {z} cups"), ("Group must two", "", "", "")),
    (("6.12", "The meter shall log.", "", ""), ("6.13", "The meter must not stop.", "", ""), ("6.14", "plain", "", ""), ("6.15", "plain {z}", "", ""), ("6.16", "x", "", ""), ("6.17", "", "", "")),
    (("(a) Alpha", "(b) Beta", "(c) Gamma", "(d) Beta"), ("1", "2", "3", "{z}"), ("5", "6", "7", "8"), ("a", "b", "c", "d"), ("e", "f", "g", "h"), ("i", "j", "k", "must")),
    (("The box must be red", "b", "c", "d"), ("It shall be shut", "f", "g", "h"), ("i", "j", "k", "{z}"), ("m", "n", "o", "p"), ("q", "r", "s", "t"), ("u", "v", "w", "n/a")),
)
RANGES = (((2, 2, 1, 1),), ((3, 1, 4, 1),), ((2, 4, 3, 4), (3, 3, 3, 4)), ((2, 2, 3, 2),), ((1, 1, 1, 4), (4, 1, 4, 4), (6, 1, 6, 4)), (), (), ())


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts dealt over all tasks before they are exploded: their file is small, so it is read by one or two."""
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    shapes = F.array(*(F.array(*(F.array(*map(F.lit, row)) for row in m)) for m in MATRICES))
    p = _parts(spark, d).select(F.col("p_partkey").alias("t"), F.col("p_size").cast("string").alias("z"), F.element_at(shapes, (F.col("p_partkey") % 8 + 1).cast("int")).alias("m"))
    p = p.select("t", "z", F.posexplode("m").alias("r", "row")).select("t", "z", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "x"))
    return p.select("t", "r", (F.col("c") + 1).alias("c"), F.replace("x", F.lit("{z}"), "z").alias("text"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<array<struct<r1:int,c1:int,r2:int,c2:int>>>"
    shapes = F.array(*(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("r1", "c1", "r2", "c2"), strict=True))) for r in rs)).cast("array<struct<r1:int,c1:int,r2:int,c2:int>>") for rs in RANGES)).cast(kind)
    p = _parts(spark, d).select(F.col("p_partkey").alias("t"), F.explode(F.element_at(shapes, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("x"))
    return p.select("t", "x.*")


_BY = ["t"]


def _all(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    cells, ranges = _cells(spark, d), _ranges(spark, d)
    found = written(tables.facts(cells, _BY), "facts")
    tabs, rows = tables.structure(found, written(tables.rows_of(found, ranges, _BY), "rows"), _BY)
    tabs, rows = written(tabs, "tables"), written(rows, "roles")
    heads = written(tables.headers(found, rows, tabs, _BY), "headers")
    dims = written(tables.fact_columns(found, rows, heads, _BY), "dimensions")
    kind = written(tables.kinds(found, rows, heads, dims, _BY), "kinds")
    return {"cells": cells, "ranges": ranges, "found": found, "rows": rows, "tabs": tabs, "heads": heads, "dims": dims, "kind": kind}


def _planned(x: dict[str, DataFrame]) -> DataFrame:
    return written(tables.leaves(x["found"], x["rows"], x["heads"], x["dims"], x["kind"], x["ranges"], _BY), "leaves")


def _values(rows: list[tuple], names: str) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_STRUCTURES = [
    (0, "1", "inferred", "first_row_header:default", 5, 0),
    (1, "1", "inferred", "first_row_header:default", 5, 0),
    (2, "1", "inferred", "first_row_header:default", 5, 0),
    (3, "1", "inferred", "first_row_header:default", 5, 0),
    (4, "2", "inferred", "first_row_header:default", 4, 1),
    (5, "", "inferred", "sequential_clause_rows:headerless", 6, 0),
    (6, "1", "explicit", "lettered_composite_header:inline:a,b,c,d;letter_prefixes_a_to_j:hidden_from_display", 5, 0),
    (7, "", "inferred", "first_two_rows_normative:headerless", 6, 0),
]


@_query(f"SELECT p_partkey AS t, header_rows, status, evidence, CAST(data_rows AS BIGINT) AS data_rows, CAST(titles AS BIGINT) AS titles FROM part JOIN {_values(_STRUCTURES, 'k, header_rows, status, evidence, data_rows, titles')} ON k = p_partkey % 8")
def table_structures(spark, d):
    return _all(spark, d)["tabs"].select("t", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",").alias("header_rows"), "status", F.array_join("evidence", ";").alias("evidence"), "data_rows", "titles")


_HEADERS = ["Parameter|Requirement value|Unit|Note", "Object|GET|SET|Remarks", "Topic|Duty A|Duty B|Duty C", "Name|Place|Owner|Color", "Name|Class|Mode 1|Other", "column_1|column_2|column_3|column_4", "Alpha|Beta|Gamma|Beta_2", "column_1|column_2|column_3|column_4"]


@_query(f"SELECT p_partkey AS t, CAST(c AS INT) AS c, split_part(hs, '|', c) AS header FROM part JOIN {_values(list(enumerate(_HEADERS)), 'k, hs')} ON k = p_partkey % 8, (VALUES (1), (2), (3), (4)) n(c)")
def table_headers(spark, d):
    return _all(spark, d)["heads"]


@_query(f"SELECT p_partkey AS t, CAST(c AS INT) AS c, tag FROM part JOIN {_values([(1, 2, 'operation'), (1, 3, 'operation'), (4, 3, 'axis_member')], 'k, c, tag')} ON k = p_partkey % 8")
def table_dimensions(spark, d):
    return _all(spark, d)["dims"]


_KINDS = [(0, "parameter", "mixed"), (1, "mapping_matrix", "cell"), (2, "prose_grid", "cell"), (3, "other", "row"), (4, "mapping_matrix", "cell"), (5, "other", "row"), (6, "other", "row"), (7, "other", "row")]


@_query(f"SELECT p_partkey AS t, kind, mode FROM part JOIN {_values(_KINDS, 'k, kind, mode')} ON k = p_partkey % 8")
def table_kinds(spark, d):
    x = _all(spark, d)
    return x["kind"].join(tables.leaf_modes(_planned(x), _BY), "t")


#: Leaves by shape: leaf, candidate, cells.
_LEAVES = [
    (0, "context", None, 4), (0, "row", None, 8), (0, "cell", None, 1), (0, "context", "unsignaled_data", 1), (0, "context", "untyped_colon_spec", 1),
    (1, "context", None, 12), (1, "cell", None, 9),
    (2, "context", None, 7), (2, "cell", None, 10), (2, "context", "untyped_colon_spec", 1),
    (3, "context", None, 8), (3, "row", None, 3), (3, "context", "unsignaled_data", 5), (3, "context", "weak_signal", 1),
    (4, "context", None, 9), (4, "cell", None, 6),
    (5, "row", None, 4), (5, "context", None, 1), (5, "context", "unsignaled_data", 6),
    (6, "context", None, 4), (6, "row", None, 4), (6, "context", "unsignaled_data", 16),
    (7, "row", None, 8), (7, "context", "unsignaled_data", 16),
]


@_query(f"SELECT p_partkey AS t, leaf, candidate, CAST(n AS BIGINT) AS n FROM part JOIN {_values(_LEAVES, 'k, leaf, candidate, n')} ON k = p_partkey % 8")
def table_leaves(spark, d):
    return _planned(_all(spark, d)).groupBy("t", "leaf", "candidate").agg(F.count("*").alias("n"))


#: Items of the fifth row: column, role, header path's place, context to the left.
_ITEMS = [
    (0, 1, "data", 1, 1, ""), (0, 2, "data", 1, 1, "Lid"), (0, 3, "data", 1, 1, "Lid"),
    (1, 1, "row_header", 1, 1, ""), (1, 2, "data", 1, 1, "Relay"), (1, 4, "data", 1, 1, "Relay"),
    (2, 1, "row_header", 1, 1, ""), (2, 2, "data", 1, 1, "Last"), (2, 3, "data", 1, 1, "Last"), (2, 4, "data", 1, 1, "Last"),
    (3, 1, "data", 1, 1, ""), (3, 2, "data", 1, 1, "Status: AB 1"), (3, 3, "data", 1, 1, "Status: AB 1"), (3, 4, "data", 1, 1, "Status: AB 1|Eve"),
    (4, 1, "row_header", 1, 1, "Group one"), (4, 2, "data", 1, 1, "Group one|Jar"), (4, 3, "data", 1, 1, "Group one|Jar|2"), (4, 4, "data", 1, 1, "Group one|Jar|2"),
    (5, 1, "data", 1, 1, ""), (5, 2, "data", 1, 1, "6.16"),
    (6, 1, "data", 1, 1, ""), (6, 2, "data", 1, 1, "e"), (6, 3, "data", 1, 1, "e|f"), (6, 4, "data", 1, 1, "e|f|g"),
    (7, 1, "data", 1, 1, ""), (7, 2, "data", 1, 1, "q"), (7, 3, "data", 1, 1, "q|r"), (7, 4, "data", 1, 1, "q|r|s"),
]


@_query(f"SELECT 'TBL-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-R000005-C00000' || c AS cell_id, role, CAST(rs AS INT) AS rs, CAST(cs AS INT) AS cs, context FROM part JOIN {_values(_ITEMS, 'k, c, role, rs, cs, context')} ON k = p_partkey % 8")
def table_cell_items(spark, d):
    x = _all(spark, d)
    items = tables.cell_items(_planned(x), x["cells"], x["rows"], x["ranges"], _BY, F.concat(F.lit("TBL-"), F.lpad(F.col("t").cast("string"), 6, "0")))
    return items.where("r = 5").select("cell_id", F.col("structural_role").alias("role"), F.col("row_span").alias("rs"), F.col("column_span").alias("cs"), F.array_join("row_header_context", "|").alias("context"))


@_query("SELECT p_partkey AS t, CASE p_partkey % 8 WHEN 1 THEN 'Meter ' || p_size ELSE 'Group one' END AS context, CASE p_partkey % 8 WHEN 1 THEN 1 ELSE 4 END AS span FROM part WHERE p_partkey % 8 IN (1, 4)")
def table_inherited_context(spark, d):
    x = _all(spark, d)
    items = tables.cell_items(_planned(x), x["cells"], x["rows"], x["ranges"], _BY, F.lit("T"))
    return items.where("(t % 8 = 1 and r = 4 and c = 2) or (t % 8 = 4 and r = 6)").select("t", F.array_join("row_header_context", "|").alias("context"), F.col("column_span").alias("span"))


@_query(f"SELECT p_partkey AS t, CAST(r1 AS INT) AS r1, conflict FROM part JOIN {_values([(1, 3, 0), (2, 2, 1), (2, 3, 1), (3, 2, 0), (4, 1, 0), (4, 4, 0), (4, 6, 0)], 'k, r1, x')} ON k = p_partkey % 8, LATERAL (SELECT x = 1 AS conflict)")
def table_range_conflicts(spark, d):
    return tables.range_conflicts(_cells(spark, d), _ranges(spark, d), _BY).select("t", "r1", "conflict")


@_query("SELECT p_partkey AS t FROM part WHERE p_partkey % 8 = 2")
def table_contradictions(spark, d):
    return tables.contradictory(_ranges(spark, d), _BY)


@_query(
    "SELECT p_partkey AS t, CAST(target AS BIGINT) AS target, CAST(composite AS BIGINT) AS composite, CAST(excluded AS BIGINT) AS excluded, CAST(review AS BIGINT) AS review, CASE WHEN review > 0 THEN 'pending' ELSE 'ready' END AS status FROM part JOIN "
    + _values([(0, 1, 8, 0, 2), (1, 0, 9, 0, 0), (2, 9, 1, 0, 1), (3, 0, 3, 0, 6), (4, 1, 5, 0, 1), (5, 0, 4, 0, 6), (6, 0, 4, 0, 16), (7, 0, 8, 1, 15)], "k, target, composite, excluded, review")
    + " ON k = p_partkey % 8"
)
def table_dispositions(spark, d):
    p = _planned(_all(spark, d))
    role = tables.structural_role(F.col("role"), F.col("group_header"), F.col("kind"), F.col("c"))
    verdict = records.base_disposition(F.col("text"), role, F.col("leaf"), F.col("header"), F.lit(False), F.lit(False), F.col("candidate"))["disposition"]
    n = lambda x: F.count_if(F.col("v") == x).alias(x)
    out = p.select("t", verdict.alias("v")).groupBy("t").agg(n("target"), n("composite"), n("excluded"), n("review"))
    return out.withColumn("status", F.when(F.col("review") > 0, "pending").otherwise("ready"))
