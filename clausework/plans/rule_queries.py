"""Queries over row rules, scalar expressions and outline operators, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import rules, scalars
from clausework.functions import text as tx
from clausework.operators import outline

QUERIES = {}
ORACLE = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x))
    return _t(spark, d, "documents").select("doc_id", F.explode(parts).alias("s"))


_LINES = "SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS s FROM documents"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(x)})" for x in words) + ")"


def _in(column: str, words: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(_q, words))})"


def _counted(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """Registers: the value of a rule for every line of every document, counted by document and value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _lines(spark, d).groupBy("doc_id", value(F.col("s")).alias("value")).agg(F.count("*").alias("n"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {sql} AS value, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2"


def _tagged_lines(name: str, value: Callable[[Column, Column], Column], sql: str) -> None:
    """The same for a rule of a line and its tags, which are made once."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = _lines(spark, d).withColumn("low", F.lower("s")).withColumn("tags", rules.domain_tags(F.col("s"), F.col("low")))
        return lines.groupBy("doc_id", value(F.col("s"), F.col("tags")).alias("value")).agg(F.count("*").alias("n"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {sql} AS value, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2"


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return _re(column, rules.any_pattern(patterns))


def _tagged(sql: str) -> str:
    return f"contains(',' || {_TAGS} || ',', ',{sql},')"


_NOISE = f"(lower({{0}}) = '' OR {_any('lower({0})', rules.NOISE_PATTERNS)})"
_TOC = r"(regexp_matches({0}, '\s+\d{{1,3}}$') OR ends_with(lower({0}), 'page'))"
_HEADER = r"regexp_replace(lower(trim(s)), '[\s_\-]+', ' ', 'g')"
_WORDS = r"len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''))"
_SIGNAL = (
    f"CASE WHEN trim(s) = '' THEN 'none' WHEN {_in(_HEADER, rules.MARKERS)} THEN 'marker' WHEN {_re('s', rules.MODAL)} THEN 'modal' WHEN {_re('s', rules.PATTERN)} THEN 'pattern'"
    f" WHEN {_re('s', rules.COLON_SPEC)} THEN 'colon_spec' WHEN {_re('s', r'[.!?。！？]\s*$')} AND {_WORDS} >= 5 THEN 'sentence_shape' ELSE 'none' END"
)
_LABEL, _VALUE = "regexp_extract(s, '^([^:]*):', 1)", r"regexp_extract(s, '^[^:]*:\s+(.*)$', 1)"
_TECHNICAL = f"({_re('s', rules.COLON_SPEC)} AND {_re(_LABEL, rules.SPEC_LABEL)} AND {_re(_VALUE, rules.SPEC_VALUE)})"
_LIKE = f"(NOT starts_with(trim(lower(s)), 'summary') AND ({_has('lower(s)', rules.SIGNALS)} OR {_any('lower(s)', rules.DEFINING)}))"
_TAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN {_re('lower(s)', rules.term_pattern(terms))} THEN '{tag}' END" for tag, terms in rules.DOMAINS) + ")"
_NUMBER, _TITLE = f"regexp_extract(s, {_q(rules.NUMBERED)}, 1)", f"trim(regexp_extract(s, {_q(rules.NUMBERED)}, 2))"

_counted("noise_lines", lambda _s: rules.is_noise(_s), _NOISE.format("s"))
_counted("toc_entries", lambda _s: rules.is_toc_entry(_s), _TOC.format("s"))
_counted("captions", lambda _s: rules.is_caption(_s), _re("s", rules.CAPTION))
_counted(
    "heading_levels",
    lambda _s: rules.heading_level(_s),
    f"CASE WHEN NOT ({_NUMBER} = '' OR (NOT contains({_NUMBER}, '.') AND coalesce(try_cast({_NUMBER} AS BIGINT), 99) > 40) OR {_TOC.format(_TITLE)} OR {_re('s', rules.CAPTION)} OR {_NOISE.format('s')})"
    f" THEN least(6, len(string_split({_NUMBER}, '.'))) END",
)
_counted("requirement_like_lines", lambda _s: rules.is_requirement_like(_s), _LIKE)
_counted("atomic_lines", lambda _s: rules.is_atomic_like(_s), _has("lower(s)", rules.ATOMIC_SIGNALS))
_counted("ambiguous_lines", lambda _s: rules.is_ambiguous(_s), _has("lower(s)", rules.AMBIGUOUS))
_counted("marker_lines", lambda _s: rules.is_marker(_s), _in(_HEADER, rules.MARKERS))
_counted("line_signals", lambda _s: rules.obligation_signal(_s), _SIGNAL)
_counted("technical_specs", lambda _s: rules.is_technical_spec(_s), _TECHNICAL)
_counted("metadata_specs", lambda _s: rules.is_metadata_spec(_s), f"({_re('s', rules.COLON_SPEC)} AND {_re(_LABEL, rules.METADATA_LABEL)})")
_counted("normative_lines", lambda _s: rules.is_normative(_s), f"({_SIGNAL} IN ('modal', 'pattern') OR ({_SIGNAL} = 'colon_spec' AND {_TECHNICAL}))")
_counted(
    "coverage_candidates",
    lambda _s: rules.is_coverage_candidate(_s, F.lit("paragraph"), F.lit(""), rules.is_noise(_s)),
    f"({_LIKE} AND NOT {_NOISE.format('s')} AND trim(s) <> '' AND NOT (length(s) <= 160 AND {_re('s', rules.REFERENCE_LINE)}) AND NOT {_re('s', rules.HEADING_LINE)})",
)
_tagged_lines("domain_tags", lambda _s, tags: F.array_join(tags, ","), _TAGS)
_tagged_lines("primary_domains", lambda _s, tags: rules.primary_domain(tags), f"coalesce(nullif(split_part({_TAGS}, ',', 1), ''), 'general')")
_tagged_lines(
    "requirement_types",
    lambda _s, tags: rules.requirement_type(_s, tags),
    f"CASE WHEN {_has('lower(s)', ('hls', 'lls', 'password', 'encrypt', 'authenticat'))} THEN 'security' WHEN {_has('lower(s)', ('read', 'write', 'access', 'association'))} THEN 'access_control'"
    f" WHEN {_tagged('communication_profile')} OR {_has('lower(s)', ('dlms', 'xdlms', 'communication', 'push'))} THEN 'communication'"
    f" WHEN {_tagged('cosem_object')} OR {_has('lower(s)', ('cosem', 'obis', 'logical_name', 'attribute'))} THEN 'cosem_object' WHEN {_tagged('event')} THEN 'event' ELSE 'functional' END",
)
_tagged_lines(
    "verification_methods",
    lambda _s, tags: rules.verification_method(_s, tags),
    f"CASE WHEN {_has('lower(s)', ('set to', 'access rights', 'configured', 'password', 'hls', 'lls'))} THEN 'configuration_check'"
    f" WHEN {_has('lower(s)', ('shall support', 'must support', 'service', 'push', 'notification'))} OR {_tagged('security_policy')} THEN 'test' ELSE 'inspection' END",
)
_counted(
    "requirement_classes",
    lambda _s: rules.requirement_class(_s),
    f"CASE WHEN {_re('lower(s)', rules.CAPACITY_PATTERN)} OR {_has('lower(s)', rules.NON_FUNCTIONAL + rules.CAPACITY)} THEN 'non_functional' WHEN {_has('lower(s)', rules.CONSTRAINTS)} THEN 'constraint' ELSE 'functional' END",
)
_counted("modal_actions", lambda _s: F.array_join(rules.modal_actions(_s), ","), rf"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(s), '\b(?:{'|'.join(rules.MODAL_VERBS)})\s+([a-z]+)', 1))), ',')")
_counted("condition_words", lambda _s: F.array_join(rules.connectors(_s), ","), rf"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(s), '\b(?:{'|'.join(rules.CONNECTORS)})\b'))), ',')")
_counted("number_multisets", lambda _s: F.array_join(scalars.numbers(_s), " "), r"array_to_string(list_sort(list_transform(regexp_extract_all(s, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.'))), ' ')")
_counted("line_keys", lambda _s: F.md5(scalars.key_of(_s).cast("binary")), "md5(regexp_replace(lower(s), '[^0-9a-z一-鿿]+', '', 'g'))")
_counted("number_words", lambda _s: F.md5(scalars.number_word(_s).cast("binary")), "md5(CASE WHEN " + _in("lower(trim(s))", tuple(scalars.NUMBER_WORDS)) + " THEN CAST(list_position([" + ", ".join(map(_q, scalars.NUMBER_WORDS)) + "], lower(trim(s))) - 1 AS VARCHAR) ELSE trim(s) END)")


@_query("SELECT c_custkey, 'RTM-' || substr(sha1(c_custkey || chr(31) || c_nationkey || chr(31) || c_mktsegment), 1, 16) AS edge FROM customer")
def edge_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", scalars.edge_id(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("edge"))


@_query("""WITH RECURSIVE a(p_partkey, n, letters) AS (SELECT p_partkey, p_partkey, '' FROM part UNION ALL SELECT p_partkey, (n - 1) // 26, chr(CAST((n - 1) % 26 + 65 AS INT)) || letters FROM a WHERE n > 0)
SELECT a.p_partkey, CASE WHEN letters = '' THEN 'A' ELSE letters END || p_size AS address FROM a JOIN part USING (p_partkey) WHERE n = 0""")
def cell_addresses(spark, d):
    return _t(spark, d, "part").select("p_partkey", scalars.a1(F.col("p_size"), F.col("p_partkey")).alias("address"))


_PATH = "CASE WHEN p{0} IS NOT NULL AND {1} THEN t{0} END"


@_query(
    "SELECT conv_id, turn, concat_ws('/', "
    + ", ".join([_PATH.format(1, "true"), _PATH.format(2, "(p1 IS NULL OR p2 > p1)"), _PATH.format(3, "(greatest(p1, p2) IS NULL OR p3 > greatest(p1, p2))")])
    + ") AS path FROM (SELECT conv_id, turn, "
    + ", ".join(f"max(CASE WHEN lv = {k} THEN turn END) OVER w AS p{k}, last_value(CASE WHEN lv = {k} THEN role || turn END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3))
    + " FROM (SELECT *, (turn * 7 + conv_id) % 4 AS lv FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"
)
def heading_paths(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", ((F.col("turn") * 7 + F.col("conv_id")) % 4).alias("lv"), F.concat("role", "turn").alias("title"))
    return outline.heading_path(c, "lv", "title", ["conv_id"], "turn", depth=3).select("conv_id", "turn", F.array_join("path", "/").alias("path"))


@_query(
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
    " WHERE n <= 4 OR ((r * 4 + n - 1) // n < 4 AND (r * 4 + n - 1) // n * n // 4 = r)"
)
def spread_sample(spark, d):
    return outline.stride_rows(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), 4, ["o_custkey"], ["o_orderkey"])


_DEALT = "SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_quantity > 30)"


@_query(
    f"SELECT count(*) FILTER (d.k IS NULL) AS missing, count(*) FILTER (u.k IS NULL) AS extra, count(*) FILTER (n > 1 AND u.k IS NOT NULL) AS duplicate FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 > 0) u FULL JOIN (SELECT k, count(*) AS n FROM ({_DEALT}) GROUP BY k) d ON u.k = d.k"
)
def disposition_conservation(spark, d):
    units = _t(spark, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("k"))
    dealt = _t(spark, d, "lineitem").where("l_linenumber = 1 OR (l_linenumber = 2 AND l_quantity > 30)").select(F.col("l_orderkey").alias("k"))
    return outline.conservation(units, dealt, "k")


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS v FROM part")
def later_list_wins(spark, d):
    p = _t(spark, d, "part")
    return outline.later_wins([p.select("p_partkey", F.col("p_brand").alias("v")), p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("v"))], "p_partkey")


@_query("SELECT user_id, CASE WHEN p AND n THEN 'conflict' WHEN p THEN 'covered' WHEN n THEN 'excluded' ELSE 'open' END AS resolution FROM (SELECT user_id, bool_or(event_type = 'purchase' AND value > 90) AS p, bool_or(event_type = 'click' AND value < 5) AS n FROM events GROUP BY 1)")
def claim_resolutions(spark, d):
    e = _t(spark, d, "events").select("user_id", F.expr("event_type = 'purchase' AND value > 90").alias("p"), F.expr("event_type = 'click' AND value < 5").alias("n"))
    return outline.resolutions(e, "user_id", "p", "n")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 > 0 THEN o_orderpriority ELSE o_orderstatus END AS v FROM orders")
def state_merge(spark, d):
    o = _t(spark, d, "orders")
    old = o.select("o_orderkey", F.col("o_orderpriority").alias("v"), (F.col("o_orderkey") % 4 == 0).alias("expert"))
    return outline.merged_states(old, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v")), "o_orderkey", "expert")


@_query("SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'N') AS markers, count(*) AS cells FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'N') > 0 AND 2 * count(*) FILTER (l_returnflag = 'N') >= count(*)")
def marker_columns(spark, d):
    cells = _t(spark, d, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("marked"))
    return outline.majority_columns(cells, "l_suppkey", "l_linenumber", "marked")


@_query("SELECT s_nationkey, count(*) FILTER (b >= s_suppkey) AS n FROM (SELECT *, max(s_suppkey + s_suppkey % 5) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_suppkey + s_suppkey % 5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM supplier) GROUP BY 1")
def overlapping_ranges(spark, d):
    s = _t(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + F.col("s_suppkey") % 5).alias("b"))
    return outline.overlapping(s, ["s_nationkey"], "a", "b")


_TERMS = ", ".join(f"({_q(tag)}, {_q(t)})" for tag, terms in rules.DOMAINS for t in terms)


@_query(f"SELECT DISTINCT doc_id, tag, term FROM documents, (VALUES {_TERMS}) v(tag, term) WHERE regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9])' || replace(term, '-', '\\-') || '(?:e?s)?(?:[^a-z0-9]|$)')")
def knowledge_matches(spark, d):
    terms = spark.createDataFrame([(tag, t) for tag, terms in rules.DOMAINS for t in terms], "tag string, term string")
    return outline.term_matches(_t(spark, d, "documents").select("doc_id", "text"), "text", terms, "tag", "term").select("doc_id", "tag", "term")


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[0-9a-z]+'), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(map(_q, scalars.STOPWORDS)) + ")))"


@_query(
    f"SELECT doc_id, score FROM (SELECT doc_id, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS score FROM (SELECT doc_id, {_TOKENS.format('text')} AS a, {_TOKENS.format(_q('water light stone and the river house'))} AS b FROM documents))"
    " ORDER BY score DESC, doc_id LIMIT 20"
)
def library_search(spark, d):
    query = scalars.search_tokens(F.lit("water light stone and the river house"))
    score = scalars.token_jaccard(scalars.search_tokens(F.col("text")), query)
    return _t(spark, d, "documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


_LIKE_TEXT = _LIKE.replace("lower(s)", "lower(t)")


@_query(
    f"""WITH RECURSIVE b AS (SELECT conv_id, turn, length(t) AS n, role AS sec, {_LIKE_TEXT} AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT *, coalesce(text, '') AS t FROM conversations)),
r(conv_id, turn, i, chunk, held, own) AS (SELECT conv_id, turn, i, 1, n, sec FROM b WHERE i = 1 UNION ALL SELECT b.conv_id, b.turn, b.i, r.chunk + e.e, CASE WHEN e.e = 1 THEN b.n ELSE held + b.n END, CASE WHEN e.e = 1 THEN b.sec ELSE own END
 FROM r JOIN b ON b.conv_id = r.conv_id AND b.i = r.i + 1, LATERAL (SELECT CASE WHEN (b.h AND held >= 140) OR (b.sec <> own AND held >= 200) OR held + b.n > 400 THEN 1 ELSE 0 END AS e) e) SELECT conv_id, turn, chunk FROM r"""
)
def packed_chunks(spark, d):
    kind = F.when(rules.is_requirement_like(F.col("text")), "heading").otherwise("paragraph")
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("size"), kind.alias("kind"), F.col("role").alias("section"))
    return outline.packed(c, "conv_id", "turn", "size", "kind", "section", 400).select("conv_id", "turn", "chunk")
