"""Queries over object models: twenty-four parts make a document of four tables, whose attributes reach every rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import objects as ob

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: place, table, row, object name or parent, class id (objects) or attribute, and whether it is an object; {d} is the document.
PLAN = (
    (1, "T-000001", 1, "Load {d}", "7", 1), (2, "T-000001", 2, "Load {d}", "buffer", 0), (3, "T-000001", 3, "Energy {d}", "3", 1), (4, "T-000001", 4, "Energy {d}", "value", 0),
    (5, "T-000001", 5, "Ener", "scaler_unit", 0), (6, "T-000001", 6, "value", "value", 0), (7, "T-000001", 7, "Register", "scaler unit", 0), (8, "T-000001", 8, "Zzz", "buffer", 0),
    (9, "T-000002", 1, "Zzz", "value", 0), (10, "T-000002", 2, "Relay {d}", "70", 1), (11, "T-000002", 3, "Relay {d}", "control_mode", 0), (12, "T-000002", 4, "Energy {d}", "value", 0),
    (13, "T-000002", 5, "Zzz", "capture_period", 0), (14, "T-000002", 6, "Zzz", "nonsense", 0), (15, "T-000002", 7, "", "nothing", 0), (16, "T-000002", 8, "Disconnect Control", "output_state", 0),
    (17, "T-000003", 1, "Later {d}", "1", 1), (18, "T-000003", 2, "Later {d}", "value", 0), (19, "T-000003", 3, "Data", "join-strategy", 0), (20, "T-000003", 4, "Profile Generic", "sort method", 0),
    (21, "T-000003", 5, "Zzz", "scaler_unit", 0), (22, "T-000005", 1, "Zzz", "value", 0), (23, "T-000005", 2, "Zzz", "control_mode", 0), (0, "T-000005", 3, "Load {d}", "buffer", 0),
)
_TITLES = {"T-000001": "Objects", "T-000002": "Objects (continued)", "T-000003": "Other", "T-000005": "Other"}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.createDataFrame([(*p, _TITLES[p[1]]) for p in PLAN], "k long, tbl string, row int, name string, more string, is_object int, title string")
    p = spark.read.parquet(f"{d}/part.parquet").select(F.floor(F.col("p_partkey") / 24).alias("doc"), (F.col("p_partkey") % 24).alias("k"), F.col("p_partkey").alias("id"))
    r = p.join(F.broadcast(plan), "k").withColumn("name", F.replace("name", F.lit("{d}"), F.col("doc").cast("string")))
    return r.withColumn("ord", F.when(F.col("k") == 0, 24).otherwise(F.col("k")))


def _objects(r: DataFrame) -> DataFrame:
    return r.where("is_object = 1").select("doc", F.concat(F.lit("O"), F.col("k")).alias("oid"), "ord", "name", F.col("more").alias("class_id"), "tbl", "row")


def _attrs(r: DataFrame) -> DataFrame:
    return r.where("is_object = 0").select("doc", F.col("id").alias("aid"), "ord", F.col("name").alias("parent"), F.col("more").alias("attr"), "tbl", "row")


#: place -> object's place, rule.
_WANT = "(VALUES (2, 1, 1), (4, 3, 1), (5, 3, 4), (6, 3, 5), (7, 3, 9), (8, 1, 12), (9, 3, 6), (11, 10, 1), (12, 3, 2), (13, 1, 6), (16, 10, 9), (18, 17, 1), (19, 17, 9), (20, 1, 11), (22, 17, 8), (23, 10, 8), (0, 1, 2)) v(k, o, rule)"
_FULL = "(SELECT p_partkey // 24 AS doc FROM part GROUP BY 1 HAVING count(*) = 24)"


@lambda f: QUERIES.setdefault("attribute_parents", f)
def attribute_parents(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    whole = r.groupBy("doc").count().where("count = 24").select("doc")
    return ob.parents(_attrs(r), _objects(r), ["doc"]).join(whole, "doc", "left_semi").select("doc", "aid", "oid", F.col("rule").cast("int").alias("rule"))


ORACLE["attribute_parents"] = f"SELECT p_partkey // 24 AS doc, p_partkey AS aid, 'O' || o AS oid, rule FROM part JOIN {_WANT} ON k = p_partkey % 24 WHERE p_partkey // 24 IN (SELECT doc FROM {_FULL})"


@lambda f: QUERIES.setdefault("object_model", f)
def object_model(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    whole = r.groupBy("doc").count().where("count = 24").select("doc")
    r = r.join(whole, "doc", "left_semi")
    rows = r.where("is_object = 1").select("doc", "ord", "name", F.lit("1-0:1.8.0.255 1-0:2.8.0.255").alias("codes"), F.col("more").alias("class_id"), F.col("id").cast("string").alias("item_id"), "tbl", "row")
    again = rows.where("name like 'Load%'").withColumn("ord", F.lit(99))
    objects, conflicts = ob.objects_of(rows.unionByName(again), ["doc"])
    a = _attrs(r)
    found = ob.parents(a, _objects(r), ["doc"])
    return ob.model_counts(objects, conflicts, a, found, r.where("k = 5"))


ORACLE["object_model"] = f"WITH f AS (SELECT count(*) AS n FROM {_FULL}) SELECT 8 * n AS objects, 20 * n AS attributes, 17 * n AS attached, n AS units, 2 * n AS conflicts, 3 * n AS orphans FROM f"


@lambda f: QUERIES.setdefault("object_instances", f)
def object_instances(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    head = F.create_map(F.lit("Object/attribute name"), "name", F.lit("CL"), "more")
    other = F.create_map(F.lit("Object/attribute name"), "more", F.lit("#"), F.lit("1"))
    items = r.select("doc", "ord", "tbl", "title", F.lit("4.1").alias("section"), F.lit("").alias("continued_from"), F.when(F.col("is_object") == 1, head).otherwise(other).alias("fields"))
    whole = r.groupBy("doc").count().where("count = 24").select("doc")
    i = ob.instances(items, ["doc"]).join(whole, "doc", "left_semi")
    return i.where("instance is not null").groupBy("doc", "instance").agg(F.count_if(~F.col("is_header")).alias("attributes"))


ORACLE["object_instances"] = f"SELECT doc, CAST(i AS BIGINT) AS instance, CAST(n AS BIGINT) AS attributes FROM {_FULL}, (VALUES (1, 1), (2, 6), (3, 6), (4, 7)) v(i, n)"


@lambda f: QUERIES.setdefault("canonical_attributes", f)
def canonical_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("is_object = 0").select("id", ob.canonical_attribute(F.col("name"), F.col("more")).alias("attr"))


ORACLE["canonical_attributes"] = "SELECT p_partkey AS id, a AS attr FROM part JOIN (VALUES " + ", ".join(f"({k}, '{ {7: 'scaler_unit', 19: 'join_strategy', 20: 'sort_method'}.get(k, m) }')" for k, _, _, _, m, o in PLAN if not o) + ") v(k, a) ON k = p_partkey % 24"
