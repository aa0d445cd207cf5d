"""Queries over routes, owners, labels, patterns and terms of clauses; the SQL has its own literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import routing as ro
from clausework.operators import windows
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


_A = r"(regexp_matches(s, '\d+-\d+:\d+(\.\d+){3}') OR (regexp_matches(s, '(?i)\b(class|cl)\s*=?\s*\d{1,3}\b') AND len(list_filter(regexp_extract_all(s, '(?i)\b(?:class|cl)\s*=?\s*(\d{1,3})\b', 1), lambda x: x IN ('1','3','4','5','6','7','8','9','10','11','12','15','17','18','20','22','61','62','64','70'))) > 0) OR h)"
_B = r"(regexp_matches(s, '(?i)\b(shall|must|will|may|should|need to)\b') OR regexp_matches(s, '必须|需要|应|须|宜') OR regexp_matches(s, '(?i)\brequired\b|\bmandatory\b|不得') OR lower(trim(s)) IN ('x', 'yes', 'true', 'required', 'mandatory', 'applicable'))"
_UNITS = f"(SELECT id, s, CASE id % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'table_row' WHEN 2 THEN 'narrative' ELSE 'paragraph' END AS kind, id % 7 = 0 AS h, CASE id % 3 WHEN 0 THEN 'review_candidate' WHEN 1 THEN 'context' ELSE 'plain' END AS role, CASE id % 11 WHEN 0 THEN 'composite' WHEN 1 THEN 'excluded' ELSE '' END AS d FROM {CLAUSES})"


@_query(
    rf"""SELECT id, CASE WHEN kind = 'heading' THEN 'context_by_kind' WHEN kind = 'table_row' AND d = 'composite' AND (a OR b) THEN 'table_composition_a_authority' WHEN kind = 'table_row' AND d = 'excluded' AND (a OR b) THEN 'context_by_disposition'
 WHEN kind = 'table_row' AND h THEN 'cosem_table_a_priority' WHEN a AND b THEN 'hard_ab_mixed' WHEN a THEN 'hard_a_only' WHEN b THEN 'hard_b_only' WHEN kind = 'narrative' THEN 'context_by_kind' WHEN role = 'review_candidate' THEN 'review_disposition'
 WHEN w THEN 'review_weak_signal' WHEN role = 'context' THEN 'context_by_disposition' ELSE 'review_no_signal' END AS rule FROM (SELECT *, {_A} AS a, {_B} AS b, regexp_matches(trim(s), '^[A-Za-z][^:0-9]{{2,60}}:\s+(\S*\d|[IVX]{{1,6}}\b|[A-Z]{{2,}}\b)') OR (regexp_matches(s, '[.!?]\s*$') AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= 5) AS w FROM {_UNITS})"""
)
def routed_units(spark, d):
    k = F.col("id")
    kind = F.when(k % 5 == 0, "heading").when(k % 5 == 1, "table_row").when(k % 5 == 2, "narrative").otherwise("paragraph")
    headers = F.when(k % 7 == 0, F.array(F.lit("CL"))).otherwise(F.array().cast("array<string>"))
    role = F.array(F.when(k % 3 == 0, "review_candidate").when(k % 3 == 1, "context").otherwise("plain"))
    return clauses(spark, d).select("id", ro.unit_route(F.col("s"), kind, role, headers, F.when(k % 11 == 0, "composite").when(k % 11 == 1, "excluded").otherwise(""))["rule"].alias("rule"))


@_query(
    rf"""SELECT id, CASE WHEN regexp_matches(l, 'walk by|concentrator|flash') THEN 'co_design' WHEN NOT sw AND hw THEN 'hardware' ELSE 'software' END AS owner FROM (SELECT id, lower(s) AS l,
 regexp_matches(lower(s), '(^|[^a-z0-9])(enclosure|battery|va)($|[^a-z0-9])') AS hw, regexp_matches(lower(s), '(^|[^a-z0-9])(dlms|cosem|obis|xdlms|action|event|profile|tariff|billing|push|p1|display|upgrade|clock)($|[^a-z0-9])') AS sw FROM {CLAUSES})"""
)
def clause_owners(spark, d):
    return clauses(spark, d).select("id", ro.ownership(F.col("s"))["owner"].alias("owner"))


@_query("SELECT * FROM (VALUES (1, 'software', '时钟'), (2, 'software', NULL), (3, 'hardware', '电池'), (4, 'software', '时钟'), (5, 'co_design', '波特率'), (6, 'software', '事件')) v(i, owner, term)")
def owners_of_short_terms(spark, d):
    rows = [(1, "时钟应同步"), (2, "时钟计数器型号"), (3, "电池寿命"), (4, "时钟计数器型号 可同步"), (5, "波特率与时钟"), (6, "事件 xxxxxxxxxxxxxxxxxxxx 芯片; 另")]
    o = ro.ownership(F.col("s"))
    return spark.createDataFrame(rows, "i int, s string").select("i", o["owner"].alias("owner"), o["term"].alias("term"))


@_query(
    f"""SELECT id, label, CASE WHEN label = '状态字' THEN 'status' WHEN id % 13 = 0 THEN 'load_profile' WHEN regexp_matches(l, 'load profile|load curve') THEN 'load_profile'
 ELSE CASE label WHEN '结算' THEN 'billing' WHEN '时钟' THEN 'time' WHEN '事件记录' THEN 'events' WHEN '安全' THEN 'security' WHEN '费率' THEN 'tariff' WHEN '升级' THEN 'firmware' WHEN '曲线' THEN 'load_profile' WHEN '计量' THEN 'metering' ELSE 'communication' END END AS module
 FROM (SELECT id, lower(s) AS l, CASE WHEN id % 17 = 0 THEN '事件记录' WHEN id % 13 = 0 OR regexp_matches(lower(s), 'load profile|load curve') THEN '曲线' WHEN contains(lower(s), 'security') THEN '安全' WHEN regexp_matches(lower(s), 'udp|tcp|communication') THEN '通信协议'
 WHEN regexp_matches(lower(s), 'period|billing') THEN '结算' WHEN regexp_matches(lower(s), 'time|clock') THEN '时钟' WHEN regexp_matches(lower(s), 'event|log') THEN '事件记录' WHEN regexp_matches(lower(s), 'auth|key|hls') THEN '安全' WHEN regexp_matches(lower(s), 'rate') THEN '费率'
 WHEN regexp_matches(lower(s), 'firmware') THEN '升级' WHEN regexp_matches(lower(s), 'register|current|voltage|energy') THEN '计量' ELSE '通信协议' END AS label FROM {CLAUSES})"""
)
def clause_modules(spark, d):
    k = F.col("id")
    kind = F.when(k % 17 == 0, "event_definition").otherwise("functional")
    domain = F.when(k % 13 == 0, "load_profile").otherwise("")
    label = ro.domain_label(kind, domain, F.lit(""), F.col("s"), F.array(F.lit("4.1 Rules")))
    c = clauses(spark, d).select("id", "s", domain.alias("dom"), label.alias("label"))
    return c.select("id", "label", ro.module_label(F.col("dom"), F.col("label"), F.col("s")).alias("module"))


PATTERNS = (
    {"pattern_id": "p1", "domain_type": "event", "trigger": {"source_type": "row", "required_fields": ["fields.name"]}, "template": "{fields.name} shall be {fields.size}.", "object": "{ fields.name }", "default_confidence": 0.9},
    {"pattern_id": "p2", "trigger": {"field_equals": {"fields.size": "7"}}, "template": "size {fields.size} {fields.none}"},
)


@_query(
    "SELECT p_partkey AS id, 'p1' AS pattern_id, 'event' AS requirement_type, p_name AS object, p_name || ' shall be ' || p_size || '.' AS requirement, 0.9 AS confidence FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0"
    " UNION ALL SELECT p_partkey, 'p2', 'p2', '', 'size 7', 0.75 FROM part WHERE p_size = 7"
)
def applied_patterns(spark, d):
    p = _t(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name"))
    body = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 == 0, "cell").otherwise("row").alias("source_type"), F.struct(name.alias("name"), F.col("p_size").alias("size")).alias("fields")))
    return p.select(F.col("p_partkey").alias("id"), F.explode(ro.applied_patterns(body, list(PATTERNS))).alias("x")).select("id", "x.*")


@_query(
    rf"""WITH t AS (SELECT unnest(list_concat(regexp_extract_all(s, '(?i)\b(?:IEC|ISO|ABNT|NBR|EN|IEEE)\s*\d{{3,6}}(?:-\d+)*(?::\d{{4}})?\b'), regexp_extract_all(s, '\b[A-Z][A-Z0-9]+(?:/[A-Z0-9]{{2,}})+\b'), regexp_extract_all(s, '\b[A-Z]{{2,}}(?:-[A-Z0-9]{{2,}})+\b'),
 list_filter(regexp_extract_all(s, '\b[A-Z]{{2,8}}\b'), lambda x: x NOT IN ('THE','AND','FOR','WITH','THIS','THAT','FROM','TABLE','FIGURE','STANDARD','BRAZILIAN','REQUIREMENTS')),
 list_filter(list_transform(regexp_extract_all(s, '\b(?:[A-Z][a-z]+|[A-Z]{{2,}})(?:\s+(?:[A-Z][a-z]+|[A-Z]{{2,}}|of|and|for)){{1,5}}\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')), lambda x: length(x) > 5))) AS term, id FROM {CLAUSES})
SELECT term, count(*) AS n, min(id) AS first FROM t GROUP BY 1 HAVING count(*) >= 2"""
)
def extracted_terms(spark, d):
    t = clauses(spark, d).select("id", F.explode(ro.candidate_terms(F.col("s"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n >= 2")


@_query(
    rf"""SELECT id, regexp_matches(s, '(?i)^\d+ shall support Value') OR false AS low, CASE WHEN len(list_filter(regexp_extract_all(s, '\d+'), lambda x: NOT list_contains(regexp_extract_all(s || ' 5 ', '\d+'), x))) = 0 THEN true ELSE false END AS safe,
 len(list_filter(list_distinct(regexp_extract_all(s, '\d+-\d+:\d+(?:\.\d+)+')), lambda x: true)) AS drift FROM {CLAUSES} WHERE NOT contains(s, '0x0') AND NOT contains(s, 'SG')"""
)
def clause_drift(spark, d):
    c = clauses(spark, d).where("not contains(s, '0x0') and not contains(s, 'SG')")
    low = ro.low_information(F.col("s"), F.lit("functional"), F.lit(False), F.lit(""), F.lit(""))
    return c.select("id", low.alias("low"), ro.safe_title(F.col("s"), F.concat("s", F.lit(" 5 "))).alias("safe"), F.size(ro.drift_of_codes(F.col("s"), F.lit("nothing"))).cast("long").alias("drift"))


@_query("SELECT p_partkey AS id, p_partkey % 4 < 2 AS low FROM part")
def low_information_rows(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "seven shall support Value.").when(k == 1, '3 | not used, must be set to "0"').when(k == 2, "seven shall support Values").otherwise("")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), ro.low_information(text, F.lit("functional"), F.lit(False), F.lit(""), F.lit("")).alias("low"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand || ',' || p_type ELSE p_brand END AS xs FROM part")
def unique_strings(spark, d):
    xs = F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_brand"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(ro.unique_strings(xs), ",").alias("xs"))


@_query("SELECT o_custkey, o_orderkey, CAST(total AS BIGINT) AS total FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE i BETWEEN 3 AND 4")
def paged_rows(spark, d):
    return windows.page(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], limit=2, offset=2).select("o_custkey", "o_orderkey", "total")


@_query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1")
def clamped_page(spark, d):
    return windows.page(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], limit=-5, offset=-9).select("o_custkey", "o_orderkey")
