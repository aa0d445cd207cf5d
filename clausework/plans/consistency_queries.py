"""Queries over quotes and blocks: ten clauses make a document, and every document has quotes of eight kinds whose blocks are known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import consistency as con
from clausework.plans.clause_queries import CLAUSES, clauses
from clausework.sources.store import written

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


#: Ten blocks a document; the eighth is noise.
_BLOCKS = f"(SELECT id // 10 AS doc, id % 10 AS ord, 'B' || id AS block_id, 'Clause ' || id || ' says: ' || s AS text, id % 10 = 8 AS noise FROM {CLAUSES})"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d).select(F.floor(F.col("id") / 10).alias("doc"), (F.col("id") % 10).alias("ord"), F.concat(F.lit("B"), F.col("id")).alias("block_id"), F.concat(F.lit("Clause "), F.col("id"), F.lit(" says: "), "s").alias("text"), (F.col("id") % 10 == 8).alias("noise"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    t = _blocks(spark, d).groupBy("doc").pivot("ord", list(range(10))).agg(F.first("text"))
    c = lambda i: F.coalesce(F.col(str(i)), F.lit("Clause -1 says:"))
    kinds = [
        F.upper(F.regexp_replace(c(3), " ", "   ")),
        F.substring(c(4), 3, 10_000),
        F.concat(F.substring(c(5), 9, 10_000), F.substring(c(6), 1, 14)),
        F.concat(c(7), F.lit("zz")),
        F.lit("unrelated text that stands nowhere at all"),
        F.concat(c(2), F.lit("\n"), c(9)),
        F.lit("short"),
        c(8),
        F.concat(c(1), F.lit("..."), c(8)),
    ]
    return t.select("doc", F.posexplode(F.array(*kinds)).alias("rid", "quote"))


_FULL = f"(SELECT doc FROM {_BLOCKS} GROUP BY doc HAVING count(*) = 10)"
_WANT = "(VALUES (0, [3], 'exact'), (1, [4], 'contains'), (2, [5, 6], 'multi_block'), (3, [7], 'contains'), (4, [], ''), (5, [2, 9], 'multi_block'), (6, [], ''), (7, [], ''), (8, [1], 'contains')) v(rid, ks, method)"


@_query(f"SELECT doc, CAST(rid AS INT) AS rid, array_to_string(list_transform(ks, lambda k: 'B' || (doc * 10 + k)), ',') AS blocks, method FROM {_FULL}, {_WANT}")
def quote_matches(spark, d):
    blocks = _blocks(spark, d)
    whole = blocks.groupBy("doc").count().where("count = 10").select("doc")
    found = con.match_quotes(_quotes(spark, d).join(whole, "doc", "left_semi"), blocks, "doc", "rid", "quote")
    return found.select("doc", "rid", F.array_join("block_ids", ",").alias("blocks"), "method")


def _done(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = _blocks(spark, d)
    return blocks, written(con.match_quotes(_quotes(spark, d), blocks, "doc", "rid", "quote"), "matches")


@_query(f"SELECT b.doc, CAST(9 AS BIGINT) AS total, CAST(8 AS BIGINT) AS covered, 0.8889 AS ratio, 'B' || (b.doc * 10) AS uncovered FROM {_FULL} b")
def quote_coverage(spark, d):
    blocks, matches = _done(spark, d)
    whole = blocks.groupBy("doc").count().where("count = 10").select("doc")
    gaps = con.coverage_gaps(blocks.where("not noise").select("doc", "ord", "block_id", "text"), con.covered(matches, "doc"), "doc")
    return gaps.join(whole, "doc", "left_semi").withColumn("uncovered", F.array_join("uncovered", ","))


@_query(
    f"""WITH q AS (SELECT lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS q, id FROM {CLAUSES})
SELECT md5(q) AS quote, count(*) AS n, min(id) AS first, list_sort(list_distinct(list(id % 3)))[1] AS section FROM q WHERE length(q) >= 12 GROUP BY q HAVING count(*) > 1"""
)
def quote_duplicates(spark, d):
    c = clauses(spark, d).withColumn("section", (F.col("id") % 3).cast("string"))
    dup = con.duplicates(c, "id", "s", "section")
    return dup.select(F.md5(F.col("quote").cast("binary")).alias("quote"), "n", F.get("members", F.lit(0)).alias("first"), F.get("sections", F.lit(0)).cast("long").alias("section"))


_CODES = r"list_distinct(list_concat(regexp_extract_all(s, '\d+-\d+:\d+(?:\.\d+)+'), list_transform(regexp_extract_all(s, 'G[\d,\s]*-?SG\w+-E\w+'), lambda x: trim(x)), regexp_extract_all(s, '0x[0-9A-Fa-f]+')))"


@_query(
    rf"""WITH c AS (SELECT id, s, {_CODES} AS codes FROM {CLAUSES}), o AS (SELECT id, codes, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(s, '\d+'), lambda x: NOT list_contains(regexp_extract_all(array_to_string(codes, ' '), '\d+'), x)))), ' ') AS ints FROM c),
u AS (SELECT id, ints, unnest(codes) AS code FROM o) SELECT code, count(*) AS n, min(id) AS first, min(ints) <> max(ints) AS values_differ FROM u GROUP BY code HAVING count(*) > 1"""
)
def code_coreferences(spark, d):
    c = clauses(spark, d).withColumn("section", F.lit("4"))
    return con.coreferences(c, "id", "s", "section").select("code", "n", F.get("members", F.lit(0)).alias("first"), "values_differ")


@_query(
    f"SELECT doc, kind, count(*) AS n FROM (SELECT doc, unnest(CASE WHEN k THEN ['pass'] ELSE ['fail'] END) AS kind FROM (SELECT id // 10 AS doc, NOT regexp_matches(s, '0x0|[0-9]-[0-9]:|SGAll-E') AS k FROM {CLAUSES} WHERE id % 10 = 4)) GROUP BY 1, 2"
)
def evidence_checks(spark, d):
    blocks = _blocks(spark, d)
    # a row quotes its own block in name only: its sources are the block before, which has none of its codes
    rows = blocks.where("ord = 4").select("doc", F.lit(1).alias("rid"), "text", F.array(F.concat(F.lit("B"), F.col("doc") * 10 + 3)).alias("source_ids"))
    nothing = rows.select("doc", "rid", F.array().cast("array<string>").alias("block_ids"))
    bad = con.evidence_failures(rows, blocks, nothing, "doc", "rid").select("doc", F.lit("fail").alias("kind"))
    return rows.join(bad, "doc", "left").select("doc", F.coalesce("kind", F.lit("pass")).alias("kind")).groupBy("doc", "kind").agg(F.count("*").alias("n"))


@_query(f"SELECT doc, layer, total, covered FROM (SELECT id // 10 AS doc, CASE WHEN (regexp_matches(s, 'valid type certificate|declaration of conformity|legal requirements|^Approved according|metrological') AND NOT regexp_matches(s, 'must communicate|shall contain')) OR s LIKE 'Price schedule%declar' THEN 'compliance' ELSE 'core' END AS layer, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (id % 10 <> 0) AS BIGINT) AS covered FROM {CLAUSES} WHERE id % 10 <> 8 AND id // 10 IN (SELECT doc FROM {_FULL}) GROUP BY 1, 2)")
def layered_coverage(spark, d):
    blocks = _blocks(spark, d)
    whole = blocks.groupBy("doc").count().where("count = 10").select("doc")
    # every block but the first is quoted by a row of its own
    rows = blocks.where("ord <> 0").select("doc", F.col("ord").alias("rid"), F.col("text").alias("quote"))
    out = con.layered_coverage(blocks.where("not noise").select("doc", "ord", "block_id", "text"), rows, blocks, "doc", "rid", "quote")
    return out.join(whole, "doc", "left_semi").select("doc", "layer", "total", "covered")


@_query(f"SELECT kind, count(*) AS n FROM (SELECT 'coverage_gap' AS kind FROM {_FULL} UNION ALL SELECT 'cross_section_duplicate' FROM (SELECT lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS q FROM {CLAUSES}) WHERE length(q) >= 12 GROUP BY q HAVING count(*) > 1) GROUP BY 1")
def reconcile_suspects(spark, d):
    c = clauses(spark, d).withColumn("section", F.lit("4"))
    blocks = _blocks(spark, d)
    whole = blocks.groupBy("doc").count().where("count = 10").select("doc")
    gaps = blocks.where("ord = 0").join(whole, "doc", "left_semi").select(F.col("block_id").alias("member"))
    found = con.suspects(con.duplicates(c, "id", "s", "section"), con.coreferences(c.where("false"), "id", "s", "section"), gaps)
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@_query(f"SELECT doc, CAST(1 AS INT) AS rid, 'E' || doc AS block_id FROM {_FULL}")
def block_echoes(spark, d):
    blocks = _blocks(spark, d)
    whole = blocks.groupBy("doc").count().where("count = 10").select("doc")
    long = F.concat(F.lit("A long sentence on how the meter keeps its clock on time for document "), "doc", F.lit(" within 5 seconds"))
    b = whole.select("doc", F.lit(0).alias("ord"), F.concat(F.lit("S"), "doc").alias("block_id"), long.alias("text"), F.lit(False).alias("noise"))
    same = whole.select("doc", F.lit(1).alias("ord"), F.concat(F.lit("E"), "doc").alias("block_id"), F.concat(long, F.lit(".")).alias("text"), F.lit(False).alias("noise"))
    other = whole.select("doc", F.lit(2).alias("ord"), F.concat(F.lit("O"), "doc").alias("block_id"), F.replace(long, F.lit(" 5 "), F.lit(" 6 ")).alias("text"), F.lit(False).alias("noise"))
    rows = whole.select("doc", F.lit(1).alias("rid"), F.lit("too short").alias("quote"), F.array(F.concat(F.lit("S"), "doc")).alias("source_ids"))
    return con.echoes(rows, b.unionByName(same).unionByName(other), "doc", "rid")
