"""Queries over groups of rows and experts' decisions; rows are made from the driver's tables, the SQL has its own literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import grouping

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 4 <> 0 UNION SELECT c_custkey, c_custkey - 7 FROM customer WHERE c_custkey % 5 = 0),
p AS (SELECT a, b FROM e WHERE b IN (SELECT c_custkey FROM customer)),
r AS (SELECT c_custkey AS s, c_custkey AS v FROM customer UNION SELECT r.s, p.b FROM r JOIN p ON p.a = r.v)
SELECT v AS c_custkey, min(s) AS "group" FROM r GROUP BY 1""")
def reach_groups(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    near = c.where(k % 4 != 0).select(k.alias("from"), (k + 3).alias("to")).unionByName(c.where(k % 5 == 0).select(k.alias("from"), (k - 7).alias("to")))
    return grouping.reach_groups(c, near, "c_custkey")


@_query("""WITH r AS (SELECT o_orderkey AS id, lower(o_orderpriority[3:]) || CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS key, o_orderstatus = 'F' AS a, o_orderstatus = 'O' AS b FROM orders WHERE o_custkey % 7 <> 0),
g AS (SELECT key, min(id) AS least, bool_or(a) AND bool_or(b) AS apart FROM r GROUP BY 1)
SELECT id, CASE WHEN apart THEN id ELSE least END AS "group", CASE WHEN apart THEN 'singleton' ELSE 'explicit_key' END AS method FROM (SELECT id, regexp_replace(key, '[^a-z0-9]', '', 'g') AS k2, key FROM r) JOIN g USING (key)""")
def explicit_groups(spark, d):
    o = _t(spark, d, "orders")
    name = F.concat(F.upper(F.substring("o_orderpriority", 3, 30)), F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.concat(F.lit(" "), "o_custkey")))
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 != 0, name).alias("key"), F.lit("").alias("subject"), "o_orderstatus")
    return grouping.explicit_groups(rows, [(F.col("o_orderstatus") == "F", F.col("o_orderstatus").isin("F", "O"))])


_CONSTRAINTS = "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'period_variant' WHEN 1 THEN 'explicit_key' WHEN 2 THEN 'event_subject' ELSE 'legacy_concept' END AS method, lower(l_linestatus) AS unit, CAST(l_quantity AS BIGINT) % 3 AS v FROM lineitem"

# the values of one row, of rows that repeat an id together
_SETS = f"SELECT l_orderkey, l_linenumber, method, unit, array_to_string(list_sort(list(DISTINCT v)), ',') AS vs FROM ({_CONSTRAINTS}) GROUP BY 1, 2, 3, 4"


def _constraints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") % 4
    method = F.when(k == 0, "period_variant").when(k == 1, "explicit_key").when(k == 2, "event_subject").otherwise("legacy_concept")
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 10).alias("group"), method.alias("method"), F.array(F.struct(F.lower("l_linestatus").alias("unit"), (F.col("l_quantity").cast("long") % 3).cast("string").alias("value"))).alias("constraints"))


@_query(f"""SELECT l_orderkey * 10 AS "group", unit, array_to_string(list_sort(list_distinct(flatten(list(string_split(vs, ','))))), ',') AS "values" FROM ({_SETS}) WHERE method <> 'period_variant' GROUP BY 1, 2 HAVING count(DISTINCT vs) > 1""")
def unit_conflicts(spark, d):
    return grouping.unit_conflicts(_constraints(spark, d)).select("group", "unit", F.array_join("values", ",").alias("values"))


@_query(f"""WITH c AS ({_CONSTRAINTS}), u AS (SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, unit FROM ({_SETS}) WHERE method IN ('event_subject', 'legacy_concept') GROUP BY 1, 2 HAVING count(DISTINCT vs) > 1)), n AS (SELECT l_orderkey, count(*) AS n FROM c GROUP BY 1)
SELECT c.l_orderkey * 10 + l_linenumber AS id, CASE WHEN u.l_orderkey IS NULL THEN c.l_orderkey * 10 ELSE c.l_orderkey * 10 + l_linenumber END AS "group", CASE WHEN u.l_orderkey IS NOT NULL OR (n = 1 AND method <> 'explicit_key') THEN 'singleton' ELSE method END AS method
FROM c JOIN n USING (l_orderkey) LEFT JOIN u USING (l_orderkey)""")
def split_conflicts(spark, d):
    return grouping.split_conflicts(_constraints(spark, d))


@_query("""WITH r AS (SELECT o_custkey AS g, CASE o_custkey % 3 WHEN 0 THEN 'explicit_key' WHEN 1 THEN 'event_subject' ELSE 'legacy_concept' END AS method, o_orderkey AS i, o_orderpriority AS p FROM orders),
f AS (SELECT g, p, min(i) AS i FROM r GROUP BY 1, 2), l AS (SELECT g, string_agg(p, ',' ORDER BY i) AS labels FROM f GROUP BY 1)
SELECT g AS "group", method, count(*) AS rows, string_agg('AI-' || i, ',' ORDER BY i) AS source_ids, min(labels) AS labels, 'FREQ-' || substr(sha1(string_agg('AI-' || i, chr(31) ORDER BY i)), 1, 12) AS function_id,
CASE WHEN method = 'explicit_key' THEN 1.0 WHEN method = 'event_subject' THEN 0.9 WHEN count(*) > 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence FROM r JOIN l USING (g) GROUP BY 1, 2""")
def merged_functions(spark, d):
    k = F.col("o_custkey") % 3
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.when(k == 0, "explicit_key").when(k == 1, "event_subject").otherwise("legacy_concept").alias("method"), F.col("o_orderkey").alias("ord"), F.array(F.concat(F.lit("AI-"), "o_orderkey")).alias("source_ids"), F.array(F.lit(""), F.col("o_orderpriority"), F.lit(None).cast("string")).alias("labels"))
    out = grouping.merged_functions(rows, ["source_ids", "labels"])
    return out.withColumn("source_ids", F.array_join("source_ids", ",")).withColumn("labels", F.array_join("labels", ","))


def _edge_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(k % 3 == 0, " Accept").when(k % 3 == 1, "REJECT ").when(k % 2 == 0, "maybe")
    return _t(spark, d, "events").select(k, F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("E"), "user_id")).alias("edge_id"), said.alias("decision"), F.col("event_type").alias("kind"))


@_query("""SELECT 'E' || user_id AS edge_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'accept' ELSE 'reject' END, event_id) AS decision, arg_max(event_type, event_id) AS kind FROM events WHERE event_id % 11 <> 0 AND event_id % 3 <> 2 GROUP BY 1""")
def replayed_edges(spark, d):
    return grouping.replayed_edges(_edge_events(spark, d), "event_id", ["kind"])


@_query("""WITH l AS (SELECT user_id, arg_max(event_id % 3, event_id) AS m FROM events WHERE event_id % 11 <> 0 AND event_id % 3 <> 2 GROUP BY 1)
SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_id % 11 = 0 OR event_id % 3 = 2) AS skipped, count(*) FILTER (m = 0) AS accepted, count(*) FILTER (m = 1) AS rejected FROM l""")
def replay_counts(spark, d):
    return grouping.replay_counts(_edge_events(spark, d), "event_id")


@_query("""WITH b AS (SELECT c_mktsegment AS m, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE '' END AS o, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'N' || c_nationkey % 3 END AS w, CASE WHEN c_custkey % 2 = 0 THEN 'N1' ELSE '' END AS x, c_custkey % 5 = 0 AS r FROM customer WHERE c_custkey % 13 <> 0),
e AS (SELECT 'module' AS kind, m AS "from", o AS "to" FROM b WHERE o <> '' AND o <> m UNION ALL SELECT 'owner', w, x FROM b WHERE w <> '' AND x <> '' AND w <> x UNION ALL SELECT 'rejected', m, '' FROM b WHERE r)
SELECT kind, "from", "to", count(*) AS n, kind <> 'rejected' AND count(*) >= 3 AS suggested FROM e GROUP BY 1, 2, 3""")
def decision_insights(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    states = c.select(k.alias("id"), F.when(k % 3 == 0, "BUILDING").alias("module_override"), F.when(k % 2 == 0, "N1").alias("owner_override"), F.when(k % 5 == 0, "rejected").alias("status"))
    items = c.where(k % 13 != 0).select(k.alias("id"), F.col("c_mktsegment").alias("module"), F.when(k % 4 != 0, F.concat(F.lit("N"), F.col("c_nationkey") % 3)).alias("owner"))
    return grouping.decision_insights(states, items)
