"""Queries over the grouping operators, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import groups

QUERIES = {}
ORACLE = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_wins_dedup(spark, d):
    return groups.first_wins(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"])


@_query("SELECT v.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('purchase'), ('withdrawn')) v(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1")
def decision_summary(spark, d):
    return groups.seeded_counts(_t(spark, d, "events"), "event_type", ["click", "purchase", "withdrawn"])


@_query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def counter_deltas(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber")
    count = lambda c: lines.where(c).groupBy("k").agg(F.count("*").alias("n"))
    return groups.counter_delta(count("l_linenumber <= 2"), count("l_linenumber >= 2"), "k", "n")


@_query("""WITH g AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS ids FROM customer GROUP BY 1), n AS (SELECT *, len(ids) AS n, greatest(1, CAST(round_even(len(ids) * 0.25, 0) AS BIGINT)) AS goal FROM g)
SELECT c_nationkey, unnest(CASE WHEN goal >= n THEN ids ELSE list_transform(range(0, goal), lambda i: ids[CAST(floor(i * (CAST(n AS DOUBLE) / goal)) AS BIGINT) + 1]) END) AS c_custkey FROM n""")
def verifier_sample(spark, d):
    return groups.stride_sample(_t(spark, d, "customer").select("c_nationkey", "c_custkey"), 0.25, ["c_nationkey"], ["c_custkey"])


@_query("""WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'column_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) ELSE o_orderpriority END AS header FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN k > 1 THEN header || '_' || k ELSE header END AS header FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, header ORDER BY o_orderkey) AS k FROM a)""")
def header_names(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority")).alias("header"))
    return groups.occurrence_suffix(o, "header", ["o_custkey"], ["o_orderkey"])


@_query("""SELECT user_id, event_type, island, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT user_id, event_id, event_type,
CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2, 3""")
def event_islands(spark, d):
    return groups.islands(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "event_type", ["user_id"], ["event_id"])


@_query("SELECT l_partkey, count(DISTINCT l_suppkey) AS members, min(l_discount) < max(l_discount) AS values_differ FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def parameter_conflicts(spark, d):
    return groups.shared_keys(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_discount")


@_query("""SELECT l_orderkey, count(*) AS n, coalesce(min(CASE WHEN l_linenumber <> i THEN i END) - 1, count(*)) AS valid
FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem) GROUP BY 1""")
def log_prefixes(spark, d):
    return groups.valid_prefix(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", ["l_orderkey"])


@_query("""WITH t AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000),
c AS (SELECT count(t.k + f.k) AS hits, count(t.k) AS truths, count(f.k) AS found FROM t FULL JOIN f ON t.k = f.k)
SELECT *, CASE WHEN truths > 0 THEN round(hits / truths, 4) ELSE 0.0 END::DOUBLE AS recall, CASE WHEN found > 0 THEN round(hits / found, 4) ELSE 0.0 END::DOUBLE AS precision FROM c""")
def truth_evaluation(spark, d):
    o = _t(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return groups.two_sided(o.where("o_orderpriority = '1-URGENT'"), o.where("o_totalprice > 200000"), "k")


@_query("""SELECT route, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 45 THEN 'review' WHEN l_discount = 0 THEN 'direct' WHEN l_linenumber = 1 THEN 'context' ELSE 'mixed' END AS route FROM lineitem) GROUP BY 1""")
def unit_routes(spark, d):
    rules = [(F.col("l_quantity") > 45, "review"), (F.col("l_discount") == 0, "direct"), (F.col("l_linenumber") == 1, "context")]
    return _t(spark, d, "lineitem").groupBy(groups.cascade(rules, "mixed").alias("route")).agg(F.count("*").alias("n"))
