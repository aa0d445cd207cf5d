"""Queries over packs, references, terms, sheet links, views, checks and evaluations; the SQL has its own literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import packing, views
from clausework.plans.clause_queries import CLAUSES, clauses

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query("""WITH RECURSIVE b AS (SELECT o_custkey AS k, o_orderkey AS o, CAST(o_totalprice / 1000 AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r(k, o, i, pack, held, closed) AS (SELECT k, o, i, 1, n, n > 300 FROM b WHERE i = 1 UNION ALL SELECT b.k, b.o, b.i, CASE WHEN closed OR b.n > 300 OR held + b.n > 300 THEN pack + 1 ELSE pack END, CASE WHEN closed OR b.n > 300 OR held + b.n > 300 THEN b.n ELSE held + b.n END, b.n > 300 FROM r JOIN b ON b.k = r.k AND b.i = r.i + 1)
SELECT k, o, pack FROM r""")
def packed_sections(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.floor(F.col("o_totalprice") / 1000 + 0.5).alias("n"))
    return packing.packs(o, ["k"], "o", "n", 300).select("k", "o", "pack")


@_query("""SELECT k, o, CAST(sum(CASE WHEN i = 1 OR n >= 75 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY o) AS BIGINT) AS unit FROM (SELECT o_custkey AS k, o_orderkey AS o, o_totalprice / 2000 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)""")
def folded_units(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), (F.col("o_totalprice") / 2000).alias("n"))
    return packing.folded(o, ["k"], "o", "n", 300).select("k", "o", "unit")


@_query(rf"""WITH c AS (SELECT id // 20 AS doc, id, nullif(regexp_extract(trim(s), '^(\d+)', 1), '') AS chapter FROM {CLAUSES})
SELECT doc, id, chapter, CAST(sum(CASE WHEN chapter IS DISTINCT FROM l OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY id) AS BIGINT) AS run FROM (SELECT *, lag(chapter) OVER (PARTITION BY doc ORDER BY id) AS l, row_number() OVER (PARTITION BY doc ORDER BY id) AS i FROM c)""")
def chapter_runs(spark, d):
    c = clauses(spark, d).select(F.floor(F.col("id") / 20).alias("doc"), "id", "s")
    return packing.chapters(c, ["doc"], "id", "s").select("doc", "id", "chapter", "run")


@_query(r"""SELECT doc_id, CASE WHEN length(t) <= 400 THEN 1 ELSE -1 END AS short, length(regexp_replace(t, '\s+', '', 'g')) AS chars, true AS fits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def cut_texts(spark, d):
    t = F.coalesce("text", F.lit(""))
    x = _t(spark, d, "documents").select("doc_id", t.alias("t"), packing.cut_text(F.col("text"), 400).alias("p"))
    bare = F.aggregate("p", F.lit(0), lambda a, s: a + F.length(F.regexp_replace(s, r"\s+", "")))
    return x.select("doc_id", F.when(F.length("t") <= 400, F.size("p")).otherwise(-1).alias("short"), bare.cast("long").alias("chars"), (~F.exists("p", lambda s: F.length(s) > 400)).alias("fits"))


@_query(f"SELECT doc, id AS o, CASE WHEN r = 1 THEN '4.' || (doc % 3) ELSE 'B' END AS clause, CASE WHEN r = 1 THEN '4.' || (doc % 3) || ' Rules' ELSE 'Annex B Tests' END AS excerpt FROM (SELECT id // 20 AS doc, id, id % 20 AS k FROM {CLAUSES}), (VALUES (1), (2)) v(r) WHERE k = 3 AND doc IN (SELECT id // 20 FROM {CLAUSES} GROUP BY 1 HAVING count(*) = 20)")
def section_references(spark, d):
    c = clauses(spark, d).select(F.floor(F.col("id") / 20).alias("doc"), F.col("id").alias("o"), (F.col("id") % 20).alias("k"))
    own = F.concat(F.lit("4."), (F.col("doc") % 3).cast("string"))
    text = F.when(F.col("k") == 3, F.concat(F.lit("As given in "), own, F.lit(", see annex b and given in "), own, F.lit(" or according to 9.9, see 7.7.")))
    text = text.when(F.col("k") == 5, F.concat(F.lit("intro\n"), own, F.lit(" Rules"))).when(F.col("k") == 6, "Annex B Tests").when(F.col("k") == 9, "7.7 Last").when(F.col("k") == 11, F.concat(own, F.lit(" again"))).otherwise("plain, see 7.8")
    whole = c.groupBy("doc").count().where("count = 20").select("doc")
    return packing.references(c.withColumn("text", text).join(whole, "doc", "left_semi"), ["doc"], "o", "text")


@_query(f"SELECT id // 20 AS doc, id AS o, t AS term FROM {CLAUSES}, (VALUES (5, 'load profile'), (6, 'load profile'), (6, 'Association'), (8, 'Association')) v(k, t) WHERE id % 20 = k AND id // 20 IN (SELECT id // 20 FROM {CLAUSES} GROUP BY 1 HAVING count(*) = 20)")
def section_terms(spark, d):
    c = clauses(spark, d).select(F.floor(F.col("id") / 20).alias("doc"), F.col("id").alias("ord"), (F.col("id") % 20).alias("k"))
    head = F.when(F.col("k") == 0, "3 Terms and definitions").when(F.col("k") == 1, "3.1 load profile").when(F.col("k") == 2, "3.2 Association").when(F.col("k") == 3, "3.3 AFD").otherwise("4 Rules")
    path = F.when(F.col("k") <= 3, F.array(F.lit("3 Terms"))).otherwise(F.array(F.lit("4 Rules")))
    text = F.when(F.col("k") == 5, "The Load Profile is kept").when(F.col("k") == 6, "an association with a load profile").when(F.col("k") == 8, "ASSOCIATIONS and AFD").otherwise("plain")
    whole = c.groupBy("doc").count().where("count = 20").select("doc")
    c = c.withColumns({"heading": head, "path": path, "text": text}).join(whole, "doc", "left_semi")
    defined = packing.terms(c, ["doc"], "heading", "path", "text")
    return packing.attached_terms(c, defined, ["doc"], "ord", "path", "text").select("doc", F.col("ord").alias("o"), "term")


@_query("SELECT o_custkey AS book, CASE WHEN o_custkey % 4 = 0 THEN 'single_sheet_table' WHEN o_custkey % 4 = 1 THEN 'key_conflict' WHEN o_custkey % 4 = 2 THEN 'linked' ELSE 'key_missing' END AS status, o_custkey % 2 = 0 AS mergeable FROM orders GROUP BY 1")
def sheet_links(spark, d):
    b = _t(spark, d, "orders").select(F.col("o_custkey").alias("book")).distinct()
    k = F.col("book") % 4
    row = lambda s, t, key: F.struct(F.lit(s).alias("sheet"), F.lit(t).alias("table_id"), F.lit(key).alias("key"))
    rows = F.when(k == 0, F.array(row("A", "t1", "x"), row("B", "t2", None))).when(k == 1, F.array(row("A", "t1", "x"), row("A", "t2", "x"), row("B", "t3", "y"))).when(k == 2, F.array(row("A", "t1", "x"), row("B", "t2", "x"))).otherwise(F.array(row("A", "t1", "x"), row("B", "t2", "y")))
    return packing.sheet_links(b.select("book", F.explode(rows).alias("r")).select("book", "r.*"), ["book"])


@_query("SELECT c_nationkey, c_custkey, CAST(total AS BIGINT) AS total FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_mktsegment = 'BUILDING') WHERE i BETWEEN 2 AND 3")
def ledger_view(spark, d):
    c = _t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return views.listed(c, ["c_nationkey"], ["c_custkey"], limit=2, offset=1, c_mktsegment="BUILDING", c_custkey="").select("c_nationkey", "c_custkey", "total")


@_query("SELECT o_orderkey, o_orderstatus AS resolution, count(l_orderkey) AS n_groups, CASE WHEN o_orderkey % 5 = 0 THEN 'pending_review' END AS review FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1, 2, 4")
def claim_catalog(spark, d):
    o = _t(spark, d, "orders")
    claims = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "weak_signal_table_cell").when(F.col("o_orderkey") % 5 == 1, "other").alias("reason"))
    groups = _t(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return views.claim_catalog(claims, o.select("o_orderkey", F.col("o_orderstatus").alias("resolution")), groups, "o_orderkey").select("o_orderkey", "resolution", "n_groups", "review")


@_query("SELECT o_custkey, o_orderkey AS group_id, CASE WHEN o_orderkey % 5 <= 3 AND o_orderstatus = 'O' THEN 'validated' ELSE 'invalid' END AS status, CASE WHEN o_orderkey % 5 <= 3 AND o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS reason, o_orderkey % 5 <= 3 AND o_totalprice > 100000 AS reused FROM orders")
def coverage_group_view(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "group_id")
    ok = F.col("o_orderstatus") == "O"
    facts = o.where("group_id % 5 <= 3").select("group_id", ok.alias("valid"), F.when(~ok, F.col("o_orderstatus")).alias("reason"), (F.col("o_totalprice") > 100000).alias("reused"))
    return views.coverage_groups(o.select("o_custkey", "group_id"), facts, "o_custkey")


@_query("""WITH a AS (SELECT l_suppkey AS k, l_linenumber AS c, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1, 2), e AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS c FROM lineitem WHERE l_orderkey % 30 = 0)
SELECT coalesce(a.k, e.k) AS k, count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicate, CAST(coalesce(sum(bad), 0) AS BIGINT) AS invalid, count(*) FILTER (a.k IS NULL) + count(*) FILTER (e.k IS NULL) + count(*) FILTER (n > 1) + coalesce(sum(bad), 0) = 0 AS ok FROM a FULL JOIN e ON a.k = e.k AND a.c = e.c GROUP BY 1""")
def conserved_dispositions(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("c"), "l_orderkey", "l_returnflag")
    return views.conserved(l.where("l_orderkey % 30 = 0"), l.where("l_orderkey % 50 = 0"), ["k"], "c", "l_returnflag", ("A", "N"))


@_query("""SELECT o_custkey AS k, count(*) AS cells, count(*) FILTER (o_orderkey % 3 = 0) AS own, count(*) FILTER (o_orderkey % 3 = 1) AS covered, count(*) FILTER (o_orderkey % 3 = 2) AS missing, CAST(1 AS BIGINT) AS extra FROM orders GROUP BY 1""")
def cell_conservation(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("cell_id"), (F.col("o_orderkey") % 3).alias("m"))
    none = F.array().cast("array<string>")
    own = o.where("m = 0").select("k", F.lit("table_cell").alias("kind"), "cell_id", none.alias("covers"))
    rows = o.groupBy("k").agg(F.concat(F.collect_list(F.when(F.col("m") < 2, F.col("cell_id"))), F.array(F.lit("none"))).alias("covers")).select("k", F.lit("table_row").alias("kind"), F.lit("").alias("cell_id"), "covers")
    return views.cell_conservation(o, own.unionByName(rows), ["k"])


@_query("""WITH t AS (SELECT s_suppkey AS tid, s_nationkey AS sec, s_suppkey % 4 AS x FROM supplier), p AS (SELECT c_custkey AS pid, c_nationkey AS sec, c_custkey % 6 AS x FROM customer), o AS (SELECT DISTINCT tid, pid FROM t JOIN p ON t.sec = p.sec AND t.x = p.x),
n AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(DISTINCT tid) FROM o) AS ht, (SELECT count(*) FROM p) AS np, (SELECT count(DISTINCT pid) FROM o) AS hp)
SELECT nt AS n_truth, ht AS hit_truth, np AS n_found, hp AS hit_found, round(ht / nt, 4) AS recall, round(hp / np, 4) AS precision, (SELECT array_to_string(list_sort(list(tid)), ',') FROM t WHERE tid NOT IN (SELECT tid FROM o)) AS miss_truth FROM n""")
def anchor_evaluation(spark, d):
    t = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_nationkey").cast("string").alias("section"), F.array((F.col("s_suppkey") % 4).cast("string"), F.lit(" ")).alias("coords"))
    p = _t(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").cast("string").alias("section"), F.array((F.col("c_custkey") % 6).cast("string")).alias("coords"))
    e = views.evaluation(t, p)
    miss = F.nullif(F.array_join(F.transform("miss_truth", lambda x: x.cast("string")), ","), F.lit(""))
    return e.select("n_truth", "hit_truth", "n_found", "hit_found", "recall", "precision", miss.alias("miss_truth"))


@_query("""SELECT 'a=' || a || ',b=' || b AS setting, count(*) FILTER (x >= a OR y >= b) AS drilled, round(count(*) FILTER ((x >= a OR y >= b) AND needs) / count(*) FILTER (needs), 4) AS recall, round(count(*) FILTER ((x >= a OR y >= b) AND needs) / nullif(count(*) FILTER (x >= a OR y >= b), 0), 4) AS precision
FROM (SELECT l_linenumber AS x, l_suppkey % 5 AS y, l_returnflag = 'N' AS needs FROM lineitem), (VALUES (2, 3), (4, 4), (9, 9)) g(a, b) GROUP BY a, b""")
def threshold_sweep(spark, d):
    p = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 5).alias("b"), (F.col("l_returnflag") == "N").alias("needs"))
    return views.threshold_sweep(p, [{"a": 2, "b": 3}, {"a": 4, "b": 4}, {"a": 9, "b": 9}])


@_query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'pass' ELSE 'needs_work' END AS execution, CASE WHEN p_partkey % 2 = 0 THEN 'pass' ELSE 'needs_work' END AS conservation,
concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'failed_units' END, CASE WHEN (p_partkey % 5 <> 0 AND p_size < 20) OR (p_partkey % 5 = 0 AND p_partkey % 4 = 0) THEN 'coverage' END, CASE WHEN p_partkey % 11 = 0 THEN 'blocking' END, CASE WHEN p_size > 30 THEN 'questions' END) AS reasons,
CASE WHEN p_partkey % 5 <> 0 THEN 'core' WHEN p_partkey % 4 = 0 THEN 'legacy' ELSE 'unavailable' END AS basis FROM part""")
def document_gates(spark, d):
    k = F.col("p_partkey")
    g = views.execution_gate(F.when(k % 3 == 0, "ok").when(k % 3 == 1, "partial"), F.when(k % 2 == 0, True))
    r = views.readiness(F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 5 != 0, F.col("p_size") * 3.0), F.when(k % 4 == 0, 10.0), F.when(k % 11 == 0, 1).otherwise(0), F.lit(0), F.col("p_size"))
    return _t(spark, d, "part").select(k.alias("id"), g["execution"].alias("execution"), g["conservation"].alias("conservation"), F.array_join(r["reasons"], ",").alias("reasons"), r["basis"].alias("basis"))


@_query("SELECT p_partkey AS id, 'deterministic' AS extracted_by, CAST(0 AS INT) AS side FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'model', 1 FROM part WHERE p_partkey % 9 = 0")
def merged_requirement_lists(spark, d):
    p = _t(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("threshold_rows"), F.lit(None).cast("string").alias("extracted_by"))
    return views.merged_lists(a, p.where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("id"), F.lit("model").alias("extracted_by")))
