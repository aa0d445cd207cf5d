"""The registered queries of the core library, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import text as tx
from clausework.operators import joins, windows
from clausework.plans import candidate_queries, clause_queries, consistency_queries, group_queries, grouping_queries, knowledge_queries, ledger_queries, object_queries, record_queries, routing_queries, rule_queries, sheet_queries, table_queries, view_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))), ',') AS ints FROM documents")
def integer_sets(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(tx.ints(F.coalesce("text", F.lit(""))), ",").alias("ints"))


@_query("SELECT token, n, docs FROM (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS token FROM documents) GROUP BY 1) ORDER BY n DESC, token LIMIT 50")
def term_frequency(spark, d):
    words = _t(spark, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    per = words.groupBy("token", "doc_id").agg(F.count("*").alias("c"))  # no distinct aggregate: two combinable counts
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "token").limit(50)


@_query("SELECT lang, count(*) AS docs, sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS labelled, round(sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) / count(*), 4) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_coverage(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id", F.lit(1).alias("y")), "doc_id", "left")
    n, m = F.count("*"), F.sum(F.coalesce("y", F.lit(0)))
    return j.groupBy("lang").agg(n.alias("docs"), m.alias("labelled"), tx.ratio(m, n, 1.0).alias("coverage"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def uncovered_orders(spark, d):
    lines = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left_anti")


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def covered_customers(spark, d):
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


_CLICK = "SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2"


@_query(f"SELECT e.event_id, c.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN ({_CLICK}) c ON e.user_id = c.user_id AND e.ts >= c.ts")
def as_of_backward(spark, d):
    e = _t(spark, d, "events")
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


@_query(f"SELECT e.event_id, c.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN ({_CLICK}) c ON e.user_id = c.user_id AND e.ts <= c.ts")
def as_of_forward(spark, d):
    e = _t(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "value", forward=True).select("event_id", "value")


@_query("SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND abs(a.s_acctbal - b.c_acctbal) <= 50")
def balance_band(spark, d):
    a = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("k"))
    b = _t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("k"))
    return joins.band(a, b, F.lit(True), "s_acctbal", "c_acctbal", 50.0, ["k"]).select("s_suppkey", "c_custkey")


@_query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 10 < 7), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 10 > 2)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k) GROUP BY 1""")
def version_diff(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    new = o.where("k % 10 > 2").withColumn("v", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("v")))
    return joins.full_diff(o.where("k % 10 < 7"), new, "k", "v").groupBy("change").agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey, l_linenumber, coalesce(a.s_name, b.s_name) AS s_name FROM lineitem LEFT JOIN supplier a ON l_partkey = a.s_suppkey LEFT JOIN supplier b ON l_suppkey = b.s_suppkey")
def first_reference(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.first_resolving(lines, _t(spark, d, "supplier"), ["l_partkey", "l_suppkey"], "s_suppkey", "s_name").select("l_orderkey", "l_linenumber", "s_name")


@_query("SELECT l_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_quantity) > 1 AS values_differ FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def code_coreference(spark, d):
    one = _t(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return one.groupBy("l_partkey").agg(F.count("*").alias("orders"), (F.min("lo") < F.max("hi")).alias("values_differ")).where("orders > 1")


@_query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def carried_turns(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.carry_forward(c, F.when(F.col("role") == "user", F.col("turn")), "asked", ["conv_id"], ["turn"]).select("conv_id", "turn", "asked")


@_query("""SELECT user_id, max(session) AS sessions FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1""")
def event_sessions(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return windows.sessions(e, "ts", 3600, ["user_id"], ["ts", "event_id"]).groupBy("user_id").agg(F.max("session").alias("sessions"))


@_query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_parts(spark, d):
    return windows.top_k(_t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), 3, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "rank")


@_query("SELECT p_brand, p_partkey, spent FROM (SELECT p_brand, p_partkey, sum(p_size) OVER w AS spent, row_number() OVER w AS i FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)) WHERE i = 1 OR spent <= 120")
def exemplar_budget(spark, d):
    return windows.within_budget(_t(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_size", 120, ["p_brand"], [F.asc("p_partkey")]).select("p_brand", "p_partkey", "spent")


@_query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def last_decisions(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return windows.last_decision(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@_query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def json_paths(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@_query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS links FROM pages")
def html_links(spark, d):
    from clausework.sources.files import html_links as links

    return _t(spark, d, "pages").select("page_id", F.size(links(F.col("html"))).alias("links"))


QUERIES |= group_queries.QUERIES
ORACLE |= group_queries.ORACLE
@_query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
c AS (SELECT page_id, regexp_extract_all(h, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS hs, string_split_regex(h, '<p[^>]*>')[2:] AS ps FROM p)
SELECT page_id AS id, CAST(len(list_filter(hs, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> '')) AS BIGINT) AS headings,
CAST(len(list_filter(ps, lambda x: trim(regexp_replace(regexp_replace(regexp_extract(x, '(?s)^(.*?)(</p>|</article>|</div>|<h[1-6]|<footer|$)', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) <> '')) AS BIGINT) AS paragraphs FROM c"""
)
def html_blocks(spark, d):
    from clausework.sources.files import html_blocks as blocks

    count = lambda x: F.count_if(F.col("type") == x)
    b = blocks(_t(spark, d, "pages"), "page_id", "html")
    return b.groupBy("id").agg(count("heading").alias("headings"), count("paragraph").alias("paragraphs"))


for module in (rule_queries, clause_queries, record_queries, table_queries, candidate_queries, consistency_queries, ledger_queries, knowledge_queries, object_queries, routing_queries, sheet_queries, view_queries, grouping_queries):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
