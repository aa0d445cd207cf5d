"""Queries over rows with fields, cells and JSON bodies made from parts; the SQL states each result with literals of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import catalog, records, tender
from clausework.plans.clause_queries import CLAUSES, clauses

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("z"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


_PART = "(SELECT p_partkey AS id, p_size AS z, p_name AS name, p_brand AS brand FROM part)"


def _rows(name: str, columns: dict[str, tuple[Callable[[], Column], str]], of=_part, sql: str = _PART) -> None:
    QUERIES[name] = lambda spark, d: of(spark, d).select("id", *(c().alias(k) for k, (c, _) in columns.items()))
    ORACLE[name] = "SELECT id, " + ", ".join(f"{q} AS {k}" for k, (_, q) in columns.items()) + f" FROM {sql}"


def _map(*pairs) -> Column:
    return F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))


def _z() -> Column:
    return F.col("z").cast("string")


# expressions are made when a query runs, as they need a session
_FIELDS = lambda: (
    F.when(F.col("id") % 4 == 0, _map("#", _z(), "Object/attribute  name", F.col("name"), "CL", "3"))
    .when(F.col("id") % 4 == 1, _map("Object/Attribute_Name", F.col("name"), "CL", F.when(F.col("id") % 3 == 0, "").otherwise(_z())))
    .when(F.col("id") % 4 == 2, _map("Service", F.col("brand"), "GET mode", "x", "SET mode", _z(), "Remarks", F.col("name"), "Status", "open"))
    .otherwise(_map("Func tion", F.when(F.col("id") % 3 == 0, "7.1").otherwise(F.col("name")), "Limit", _z(), "Range", F.concat(F.lit(" "), F.col("brand"))))
)
_rows(
    "row_fields",
    {
        "cl": (lambda: records.field(_FIELDS(), "CL"), "CASE id % 4 WHEN 0 THEN '3' WHEN 1 THEN CASE WHEN id % 3 = 0 THEN '' ELSE CAST(z AS VARCHAR) END ELSE '' END"),
        "named": (lambda: records.field(_FIELDS(), "object/attribute name"), "CASE WHEN id % 4 < 2 THEN name ELSE '' END"),
        "close": (lambda: records.field(_FIELDS(), "Function"), "CASE WHEN id % 4 = 3 THEN CASE WHEN id % 3 = 0 THEN '7.1' ELSE name END ELSE '' END"),
        "header": (lambda: records.is_object_header(_FIELDS()), "id % 4 = 0 OR (id % 4 = 1 AND id % 3 <> 0)"),
        "attribute": (lambda: records.is_attribute_row(_FIELDS()), "id % 4 = 0"),
        "non_matrix": (lambda: records.is_non_matrix_row(_FIELDS()), "id % 4 < 2"),
        "facts": (
            lambda: F.array_join(F.transform(records.valued_facts(_FIELDS()), lambda f: F.concat_ws("/", f["subject_header"], f["subject"], f["predicate_header"], f["value"])), ";"),
            "CASE WHEN id % 4 = 2 THEN 'Service/' || brand || '/SET mode/' || z WHEN id % 4 = 3 AND id % 3 <> 0 THEN 'Func tion/' || name || '/Limit/' || z || ';Func tion/' || name || '/Range/' || brand ELSE '' END",
        ),
    },
)
_ROW = lambda: F.array(F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, "X").otherwise(F.col("name")), F.when(F.col("id") % 2 == 0, " Yes").otherwise(_z()), F.when(F.col("id") % 3 == 0, "mandatory").otherwise("-"))
_ACCESS = lambda: F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, " rw/ R-/--").otherwise("-/W/RW/R/x")
_rows(
    "row_cells",
    {
        "marked": (
            lambda: F.array_join(F.transform(records.marker_facts(F.array(F.lit("Object"), F.lit("GET")), _ROW(), F.array(F.lit(2), F.lit(1), F.lit(9))), lambda f: F.concat_ws("/", f["subject"], f["predicate_header"], f["marker"])), ";"),
            "CASE WHEN id % 5 < 2 THEN '' ELSE concat_ws(';', CASE WHEN id % 2 = 0 THEN name || '/GET/Yes' END, CASE WHEN id % 3 = 0 THEN name || '/column_3/mandatory' END) END",
        ),
        "rights": (
            lambda: F.array_join(F.transform(records.access_rights(_ACCESS()), lambda a: F.concat(a["client"], F.lit("="), a["code"], a["read"].cast("int").cast("string"), a["write"].cast("int").cast("string"), a["allowed"].cast("int").cast("string"))), " "),
            "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'RC=RW111 PC=R-101 SC=--000 LC=000' ELSE 'RC=-001 PC=W011 SC=RW111 LC=R101' END",
        ),
        "cells": (lambda: F.array_join(records.access_cells(_map("RC", _z(), "LC", "R")), ","), "z || ',,,R'"),
        "text": (
            lambda: records.table_text(F.array(F.lit("a"), F.lit("b")), F.array(F.array(_z()), F.array(F.col("name"), F.lit("2"), F.lit("3")), F.array(F.col("brand"))), 2),
            "'a | b' || chr(10) || z || ' | ' || chr(10) || name || ' | 2' || chr(10) || '... 1 more rows'",
        ),
        "kind": (
            lambda: records.table_type(F.when(F.col("id") % 2 == 0, F.array(F.lit("Object/attribute name"), F.lit("CL"), F.lit("Value"))).when(F.col("id") % 3 == 0, F.array(F.lit("Event Number"))).otherwise(F.array(F.lit("x"))), F.col("id") % 7 == 0),
            "CASE WHEN id % 7 = 0 THEN 'marker_matrix' WHEN id % 2 = 0 THEN 'inherited_context_table' WHEN id % 3 = 0 THEN 'enumeration_with_code' ELSE 'row_table' END",
        ),
        "joined": (lambda: records.joined(F.when(F.col("id") % 2 == 0, F.array(_z(), F.col("name")))), "CASE WHEN id % 2 = 0 THEN z || '; ' || name ELSE '' END"),
    },
)
_SIX = lambda: F.array(
    F.when(F.col("id") % 4 == 0, "否").when(F.col("id") % 4 == 1, F.concat(F.lit("已确认（Ann "), _z(), F.lit(" 2024-05-01）"))).when(F.col("id") % 4 == 2, "yes").otherwise(F.col("name")),
    F.lit(""),
    F.lit("已确认(Bo)"),
    F.when(F.col("id") % 3 == 0, "Done").when(F.col("id") % 3 == 1, "进行中").otherwise("?"),
    F.concat(F.lit(" T1; T"), _z(), F.lit("、T3")),
    F.when(F.col("id") % 2 == 0, "是").otherwise("no"),
)
_VER = lambda: records.verification(_SIX())
_rows(
    "row_verifications",
    {
        "manager": (lambda: F.concat_ws(":", _VER()["project_manager"]["confirmed"].cast("string"), _VER()["project_manager"]["by"]), "CASE id % 4 WHEN 0 THEN 'false:' WHEN 1 THEN 'true:Ann ' || z WHEN 2 THEN 'true:' ELSE 'true:' || trim(name) END"),
        "lead": (lambda: _VER()["test_lead"]["confirmed"], "false"),
        "dev": (lambda: _VER()["dev_test"]["by"], "'Bo'"),
        "state": (lambda: _VER()["implemented"], "CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'in_progress' ELSE 'not_started' END"),
        "cases": (lambda: F.array_join(_VER()["test_case_ids"], ","), "'T1,T' || z || ',T3'"),
        "done": (lambda: _VER()["test_completed"], "id % 2 = 0"),
    },
)
_JSON = lambda: F.concat(
    F.lit('{"title": "t", "description": "d", "type": "x", "priority": "P1", "module": "m", "source_quote": "q", "source_section": "4", "notes": "", "acceptance_criteria": [], "dev_guidance": [], "labels": '),
    F.when(F.col("id") % 2 == 0, '["a"]').otherwise('"a"'),
    F.when(F.col("id") % 3 == 0, ', "source_block_ids": []').otherwise(""),
    F.when(F.col("id") % 5 == 0, ', "status": 7').otherwise(', "status": "draft"'),
    F.lit("}"),
)
_rows(
    "row_contracts",
    {
        "problems": (lambda: F.array_join(records.row_problems(_JSON()), ","), "concat_ws(',', CASE WHEN id % 3 <> 0 THEN 'source_block_ids:missing' END, CASE WHEN id % 2 = 1 THEN 'labels:not_a_list' END, CASE WHEN id % 5 = 0 THEN 'status:not_text' END)"),
        "atomic": (
            lambda: F.array_join(records.atomic_problems(F.concat(F.lit("AREQ-"), F.lpad(F.col("id").cast("string"), 5, "0"), F.when(F.col("id") % 2 == 0, "1").otherwise("")), F.lit("SREQ-0123456789ABCDEF"), {"domain": F.when(F.col("id") % 3 == 0, " ").otherwise("d")}, F.array(F.when(F.col("id") % 5 == 0, "").otherwise("r")), (F.col("id") % 12) / 10), ","),
            "concat_ws(',', CASE WHEN id % 2 = 1 THEN 'req_id' END, CASE WHEN id % 3 = 0 THEN 'domain' END, CASE WHEN id % 5 = 0 THEN 'source_refs' END, CASE WHEN id % 12 = 11 THEN 'confidence' END)",
        ),
        "entry": (lambda: records.entry_matches(F.when(F.col("id") % 2 == 0, "core"), F.when(F.col("id") % 3 == 0, "object").otherwise("event"), "core", None, ("object", "function"), None), "id % 2 = 0 AND id % 3 = 0"),
    },
)
_COMMERCIAL = lambda: tender.is_commercial_table(
    F.when(F.col("id") % 4 == 0, F.array(F.lit("Item"), F.lit("Unit_Price"))).when(F.col("id") % 4 == 1, F.array(F.lit("Parameter"))).otherwise(F.array(F.lit("Thing"))),
    F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("id") % 5 == 0, "it shall be").otherwise("ok"), F.concat(F.lit("USD "), _z()), F.concat(_z(), F.lit(" pcs")), F.when(F.col("id") % 3 == 0, "12.50 EUR").otherwise(""))),
    F.lit("Some title"),
)
_rows("commercial_tables", {"commercial": (lambda: _COMMERCIAL(), "id % 7 <> 0 AND id % 5 <> 0 AND (id % 4 = 0 OR (id % 4 <> 1 AND id % 3 = 0))")})


@lambda f: QUERIES.setdefault("function_families", f)
def function_families(spark: SparkSession, d: str) -> DataFrame:
    c = clauses(spark, d).where("s <> ''")
    f = catalog.family(F.col("s"), F.col("s"), F.lit("Mod 1"))
    return c.select("id", f["method"].alias("method"), F.col("s").alias("_s"), f["key"].alias("key")).groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.startswith("key", F.lit("mod1:"))).alias("named"))


ORACLE["function_families"] = rf"""SELECT method, count(*) AS n, count(*) AS named FROM (SELECT CASE WHEN regexp_matches(s, '(^|[^A-Za-z0-9])[A-Z]{{1,4}}[-_]?\d{{1,3}}($|[^A-Za-z0-9])') THEN 'protocol_profile_variant'
 WHEN regexp_matches(s, '(?i)(^|[^A-Za-z0-9])\d+\s*-?\s*(s|min|h|days?|months?)') AND regexp_matches(lower(s), 'archive|profile') THEN 'period_variant'
 WHEN regexp_matches(s, '(?i)[a-z][a-z\s-]{{1,40}}?\s+event') THEN 'event_subject' ELSE 'legacy_concept' END AS method FROM {CLAUSES} WHERE s <> '') GROUP BY 1"""
