"""Queries over single clauses: every part gets a clause from a list of texts that reach the branches of the rules, filled with its numbers.

The SQL states each rule with literals of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import catalog, guards, records, scalars, tender

QUERIES = {}
ORACLE = {}

TEXTS = (
    "The meter shall record {n} events within {n} min and at 5 V or 6 V.",
    "Temperature range: -25 °C to {n} °C and 230,5 V",
    "A valid type certificate shall comply with the metrological legislation in force",
    "The device must communicate a declaration of conformity every {n} days",
    "Approved according to IEC 62056-{n} and decree no. {m}/2020",
    "approval according to STN EN rules only",
    "The enclosure cover shall contain the legal requirements of act 12/{m}",
    "Instructions to Bidders",
    "Evaluation criteria {n}",
    "Technical Specification - Part {n}",
    "Qualification tests",
    "Foreword",
    "Price schedule / Form of agreement",
    "Commercial schedule",
    "1. Introduction",
    "技术规范",
    "0-0:{n}.0.0.255 class 3 SAP = 0x0{n} and class {n}",
    "CL = {n} and 1-0:1.8.0.255 or 1-0:1.8.0.255",
    "Load profile PM{n} shall be archived every {n} minutes",
    "PV-{n} Profile archive {n}h and 15min",
    "Event G1, 2-SGAll-Etwo and Gone-SGtwo-E{n} but Etwo",
    "Low battery event shall be reported",
    "The clock sync event and the very long power failure event",
    "It should respond properly",
    "Works as intended within {n} s",
    "functions normally",
    "first second {n},200 cycles and 1 008 twenty",
    "RS232 and IP54 see Clause 7.4.1 of EN 62052-11 表8 条款4.9",
    "ISO 62270 and EN ISO 62270-1 and IEC {n}{m}0",
    "必须 {n} 采集 不得 删除",
    "This may not be used",
    "This should be recommended and shall",
    "It may be used for {n} bar",
    "Annex B General",
    "B.2.{n} Letter clause",
    "{n}.{m} Two numbers",
    "4.5.6.7 Deep clause 3",
    "no number",
    "Scope .......... 12",
    "a ..... b ..... c ..... d",
    "Table 3 / Table 3 Value",
    "Attribute/Name",
    "Access/ R /W",
    "1-0:1.8.0 .255",
    "1:0-1.8.0.255",
    "0-0:96.1.0.255 1-0:2.8.{n}.255",
    "1-0 :2 8 0 255",
    "=SUM(A1)",
    "-R",
    "+12,5%",
    "@cmd",
    "R-/--/-A",
    "-12",
    "Seven",
    "0{n}",
    "Firmware image transfer with event log and key",
    "The HLS password shall be {n} characters",
    "The OBIS Meter Clock XDLMS",
    "Load control relay disconnect",
    "query the register then report",
    "Set up the access, then recover after retry",
    "EN 62052-{n}:2020",
    "This international standard specifies meters",
    "3.1 Terms and definitions",
    "at least {n} and max {m} or ≥ 5",
    "不适用",
    "n/a",
    "  Mixed   CASE: text :: ",
    "",
)


def _sql(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


CLAUSES = f"(SELECT p_partkey AS id, replace(replace(list_extract({_sql(TEXTS)}, CAST(p_partkey % {len(TEXTS)} + 1 AS INT)), '{{n}}', CAST(p_size AS VARCHAR)), '{{m}}', CAST(p_partkey % 97 AS VARCHAR)) AS s FROM part)"
#: Each clause beside the one that follows in the list.
PAIRS = f"(SELECT a.id, a.s, b.s AS t FROM {CLAUSES} a JOIN {CLAUSES} b ON b.id = a.id + 1)"


def clauses(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % len(TEXTS) + 1).cast("int"))
    s = F.replace(F.replace(s, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{m}"), (F.col("p_partkey") % 97).cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), s.alias("s"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = clauses(spark, d)
    return c.join(c.select((F.col("id") - 1).alias("id"), F.col("s").alias("t")), "id")


def _clause(name: str, columns: dict[str, tuple[Callable[[], Column], str]], source=None) -> None:
    """Registers: (expression, its SQL) by column name, for every clause or pair."""
    of, sql = (pairs, PAIRS) if source == "pairs" else (clauses, CLAUSES)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return of(spark, d).select("id", *(c().alias(k) for k, (c, _) in columns.items()))

    QUERIES[name] = run
    ORACLE[name] = "SELECT id, " + ", ".join(f"{q} AS {k}" for k, (_, q) in columns.items()) + f" FROM {sql}"


def _csv(c: Column) -> Column:
    return F.array_join(c, "|")


def _list(sql: str) -> str:
    return f"array_to_string({sql}, '|')"


def _ordered(sql: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({sql}, lambda x, i: list_position({sql}, x) = i)"


_CLEAN = r"""trim(regexp_replace(replace(translate({0}, chr(160) || chr(12288) || '‘’“”–—−', '  ''''""---'), '…', '...'), '\s+', ' ', 'g'))"""
_HEAD = r"regexp_replace(lower(trim({0})), '[\s_\-]+', ' ', 'g')"

_clause(
    "clause_normal_forms",
    {
        "match_term": (lambda: records.match_term(F.col("s")), f"lower({_CLEAN.format('s')})"),
        "title": (lambda: records.plain_title(F.col("s")), rf"regexp_replace(regexp_replace(lower({_CLEAN.format('s')}), ':+$', ''), '\s+', ' ', 'g')"),
        "plain": (lambda: records.plain_text(F.col("s")), r"lower(trim(regexp_replace(s, '\s+', ' ', 'g')))"),
        "intish": (
            lambda: records.intish(F.col("s")),
            rf"CASE WHEN list_contains(['one','two','three','four','five','six','seven','eight','nine','ten'], lower({_CLEAN.format('s')})) THEN CAST(list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], lower({_CLEAN.format('s')})) AS VARCHAR)"
            rf" WHEN regexp_full_match({_CLEAN.format('s')}, '\d+') THEN CAST(CAST({_CLEAN.format('s')} AS BIGINT) AS VARCHAR) ELSE {_CLEAN.format('s')} END",
        ),
        "row_key": (lambda: guards.row_key(F.lit(""), F.lit(" "), F.col("s")), "substr(lower(trim(s)), 1, 80)"),
    },
)
_P = f"list_filter(list_transform(string_split({_CLEAN.format('s')}, '/'), lambda x: trim(x)), lambda x: x <> '')"
_clause(
    "clause_headers",
    {
        "header": (
            lambda: records.table_header(F.col("s")),
            f"CASE WHEN contains({_CLEAN.format('s')}, '/') AND len({_P}) >= 2 THEN CASE WHEN contains({_HEAD.format(f'{_P}[-1]')}, {_HEAD.format(f'{_P}[1]')}) THEN {_P}[-1] ELSE {_P}[1] || ': ' || {_P}[-1] END ELSE {_CLEAN.format('s')} END",
        ),
        "safe": (lambda: records.formula_safe(F.col("s")), r"CASE WHEN regexp_matches(s, '^[=+\-@\t\r]') AND NOT regexp_full_match(s, '[+-]?\d+([.,]\d+)*%?') AND NOT regexp_full_match(s, '[RWAXrwax/\- ]+') THEN '''' || s ELSE s END"),
        "toc_line": (lambda: records.is_toc_line(F.col("s")), r"regexp_matches(s, '\.{5,}[\s\d]*$') OR len(regexp_extract_all(s, '\.{5,}')) >= 3"),
        "clause_key": (lambda: records.clause_key(F.col("s")), r"nullif(array_to_string(list_slice(string_split(regexp_extract(trim(s), '^(\d+(\.\d+)*)', 1), '.'), 1, 2), '.'), '')"),
        "outline": (
            lambda: _csv(records.outline_path(F.col("s"))),
            r"CASE WHEN regexp_matches(trim(s), '(?i)^annex\s+[a-z]\b') THEN upper(regexp_extract(trim(s), '(?i)^annex\s+([a-z])\b', 1)) WHEN regexp_matches(trim(s), '(?i)^[a-z]\.\d') THEN upper(s[1]) || '|' || replace(regexp_extract(trim(s), '(?i)^[a-z]\.(\d+(\.\d+)*)', 1), '.', '|')"
            r" WHEN regexp_matches(trim(s), '^\d') THEN array_to_string(list_transform(string_split(regexp_extract(trim(s), '^(\d+(\.\d+)*)', 1), '.'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '|') END",
        ),
        "table_number": (lambda: records.table_number(F.col("s")), r"CASE WHEN regexp_matches(s, '\d$') THEN CAST(regexp_extract(s, '(\d+)$', 1) AS BIGINT) END"),
    },
)
_EV = r"'G[\w,\s]*?-SG\w+-E\w+'"
_clause(
    "clause_event_ids",
    {
        "fixed": (
            lambda: records.event_ids_normal(F.col("s")),
            rf"array_to_string(list_transform(list_zip(regexp_split_to_array(s, {_EV}), list_append(regexp_extract_all(s, {_EV}), '')), lambda x: x[1] || replace(replace(replace(x[2], 'Gone-', 'G1-'), 'SGtwo-', 'SG2-'), 'Etwo', 'E2')), '')",
        )
    },
)
_OB = r"trim(regexp_replace(s, '\s+', ' ', 'g'))"
_DOT = rf"CASE WHEN contains(x, ':') THEN replace(split_part(x, ':', 1), ' ', '') || ':' || regexp_replace(trim(substr(x, strpos(x, ':') + 1)), '\s+', '.', 'g') ELSE x END"
_CODE = (
    rf"CASE WHEN NOT contains(x, ' ') THEN regexp_replace(x, '^(\d+):(\d+)-([0-9A-Za-z]+(?:\.[0-9A-Za-z]+){{3}})$', '\1-\2:\3')"
    rf" WHEN regexp_full_match(replace({_DOT}, ' ', ''), '\d+-\d+:[0-9A-Za-z]+(\.[0-9A-Za-z]+){{2,3}}') THEN replace({_DOT}, ' ', '') ELSE {_DOT} END"
)
_clause(
    "clause_codes",
    {
        "codes": (
            lambda: _csv(records.object_codes(F.col("s"))),
            _list(
                rf"list_filter(list_transform(CASE WHEN len(regexp_extract_all({_OB}, '\d+-\d+:')) >= 2 THEN list_transform(string_split(regexp_replace({_OB}, '(\d+-\d+:)', chr(31) || '\1', 'g'), chr(31)), lambda y: trim(y)) ELSE [{_OB}] END, lambda x: {_CODE}), lambda x: x <> '')"
            ),
        ),
        "obis": (lambda: _csv(records.parameters(F.col("s"))["obis_codes"]), _list(_ordered(r"regexp_extract_all(s, '\b\d+-\d+:\d+(?:\.\d+|\.x){3}\b')"))),
        "sap": (lambda: _csv(records.parameters(F.col("s"))["sap_values"]), _list(_ordered(r"regexp_extract_all(s, '\bSAP\s*=\s*0x[0-9A-Fa-f]+\b')"))),
        "classes": (lambda: _csv(records.parameters(F.col("s"))["class_ids"]), _list(_ordered(r"regexp_extract_all(s, '(?i)\b(?:class|cl)\s*=?\s*(\d{1,3})\b', 1)"))),
        "protected": (lambda: _csv(scalars.codes(F.col("s"))), _list(r"list_sort(list_distinct(list_concat(regexp_extract_all(s, '\d+-\d+:\d+(?:\.\d+)+'), list_transform(regexp_extract_all(s, 'G[\d,\s]*-?SG\w+-E\w+'), lambda x: trim(x)), regexp_extract_all(s, '0x[0-9A-Fa-f]+'))))")),
    },
)
_clause(
    "clause_identities",
    {
        "stable": (lambda: records.stable_id(F.col("id").cast("string"), F.lit("event"), F.col("s")), f"'SREQ-' || upper(substr(sha256(CAST(id AS VARCHAR) || chr(10) || 'event' || chr(10) || lower({_CLEAN.format('s')})), 1, 16))"),
        "content": (
            lambda: records.content_fingerprint(F.lit("Sub  module"), F.col("s"), F.lit("4.1"), F.lit("o"), F.lit("b"), F.lit("t")),
            r"sha1('sub module' || chr(31) || lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) || chr(31) || '4.1')",
        ),
        "fallback": (lambda: records.content_fingerprint(F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.col("s"), F.lit("b"), F.lit("T")), r"sha1(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) || chr(31) || 'b' || chr(31) || 't')"),
        "narrative": (
            lambda: records.narrative_fingerprint(F.lit("O"), F.lit(""), F.lit("d"), F.lit("t"), F.lit(None).cast("string"), F.col("id").cast("string")),
            """sha1('{"behaviors":"","description":"d","objective":"o","requirement":"","software_requirement_text":"' || CAST(id AS VARCHAR) || '","title":"t","v":"requirement-narrative-fp-v1"}')""",
        ),
        "structural": (
            lambda: records.structural_fingerprint(F.array(F.lit("1-0:2.8.0"), F.lit("0-0:1.0.0")), F.lit("Software"), F.lit("M"), F.col("id").cast("string"), F.array(F.lit("B2"), F.lit(""), F.lit("B1"))),
            """sha1('{"module":"m","obis":["0-0:1.0.0","1-0:2.8.0"],"ownership":"software","source_block_ids":["B1","B2"],"source_section":"' || CAST(id AS VARCHAR) || '","v":"requirement-structural-fp-v1"}')""",
        ),
        "candidate": (
            lambda: records.candidate_hash(F.array(F.lit("4"), F.lit("4.1")), F.lit("h"), F.col("id").cast("string"), F.array(F.lit("B1"))),
            """'sha256:' || sha256('{"domain":"clause-candidate-hash/v1","payload":{"block_ids":["B1"],"heading":"h","section_path":["4","4.1"],"text":"' || CAST(id AS VARCHAR) || '"}}')""",
        ),
    },
)
_COMP = (
    r"(regexp_matches(s, '(?i)\b(valid\s+(type\s+)?certificate|certificate\s+(according|required|of)|declaration\s+of\s+conformity|legal\s+requirements?|metrological\s+legislation|decree\s+(no\.?\s*)?\d[0-9A-Z./-]*|act\s+\d+[/-]\d+|laws?\s+in\s+force)\b')"
    r" OR regexp_matches(s, '(?i)\bapprov(ed|al)\s+according\s+to\s+(STN\s+EN|EN|IEC|ISO|OIML)\s+\d'))"
)
_clause(
    "clause_compliance",
    {
        "signal": (lambda: guards.has_compliance_signal(F.col("s")), _COMP),
        "compliance": (
            lambda: guards.is_compliance(F.col("s")),
            _COMP + r" AND NOT regexp_matches(s, '(?i)\b(shall|must)\b[^.!?;\n]{0,140}\b(record|communicate|support|report)s?\b') AND NOT regexp_matches(s, '(?i)\b(enclosure|meter|device)\b[^.!?;\n]{0,120}\b(shall|must)\b[^.!?;\n]{0,80}\bcontain\b')",
        ),
        "reference": (lambda: guards.is_reference_stub(F.col("s"), F.lit("")), r"regexp_full_match(trim(s), '(pr)?(EN|ISO|IEC|OIML|NBR|ABNT)[\s\d:.,/()\-+A-Z]*') OR regexp_matches(s, '(?i)^\s*this (international )?standard specifies')"),
        "stub": (
            lambda: guards.is_definition_stub(F.lit("3 Terms and definitions"), F.col("s"), F.lit(False)),
            r"NOT (regexp_matches(s, '(?i)\bshall\b|\bmust\b|\bshould\b|\bat least\b|\bonly\b|必须|不得') OR regexp_matches(s, '(?i)([≤≥<>±=]|max\w*|min\w*)\s*[0-9]') OR regexp_matches(s, '(^|[^A-Za-z0-9])\d+([.,]\d+)?\s*(bar|kPa|Hz|mm|cm|kg|min|%|°C|V|A|h|s|g)($|[^A-Za-z])'))",
        ),
        "region": (
            lambda: tender.region_of_heading(F.col("s")),
            r"CASE WHEN regexp_matches(lower(s), 'technical specification|qualification tests|^技术规范') THEN 'tender_technical' WHEN regexp_matches(lower(s), 'instructions to bidders|evaluation criteria|price schedule|\bdeclaration') THEN 'tender_instructions'"
            r" WHEN regexp_matches(lower(s), 'commercial schedule|\bagreement') THEN 'tender_commercial' WHEN regexp_matches(lower(s), 'foreword|introduction') THEN 'tender_preface' END",
        ),
    },
)
_UV = r"'(?:^|[^A-Za-z0-9])(\d+(?:[.,]\d+)?)\s*(l/h|m3/h|mbar|bar|kPa|Pa|MHz|kHz|Hz|mm|cm|kg|g|ms|min|%|°C|V|mA|A|mT|h|s)(?:$|[^A-Za-z])'"
_S2 = "replace(s, ' ', '  ')"
_JOIN = r"regexp_replace(regexp_replace(s, '(\d)[\s,](\d\d\d)($|\D)', '\1\2\3', 'g'), '(\d)[\s,](\d\d\d)($|\D)', '\1\2\3', 'g')"
_clause(
    "clause_numbers",
    {
        "produced": (lambda: _csv(guards.produced_ints(F.col("s"))), _list(rf"list_sort(list_distinct(regexp_extract_all({_JOIN}, '\d+')))")),
        "source": (
            lambda: _csv(guards.source_ints(F.col("s"))),
            _list(
                rf"list_sort(list_distinct(list_concat(regexp_extract_all(s, '\d+'), regexp_extract_all({_JOIN}, '\d+'), list_transform(regexp_extract_all(lower(s), '\b(first|second|two|seven|twenty)\b'),"
                r" lambda x: CASE x WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'two' THEN '2' WHEN 'seven' THEN '7' ELSE '20' END))))"
            ),
        ),
        "units": (
            lambda: F.array_join(F.transform(guards.unit_values(F.col("s")), lambda p: F.concat_ws("=", p["unit"], p["value"])), "|"),
            _list(rf"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all({_S2}, {_UV}, 2), regexp_extract_all({_S2}, {_UV}, 1)), lambda x: lower(x[1]) || '=' || replace(x[2], ',', '.'))))"),
        ),
        "softened": (lambda: guards.softened(F.col("s")), "replace(replace(s, '必须', '宜'), '不得', '不宜')"),
        "vague": (
            lambda: F.size(guards.vague_items(F.array(F.col("s")))),
            r"CASE WHEN regexp_matches(lower(s), 'properly|works as intended|functions normally') AND NOT regexp_matches(s, '[0-9≥]') THEN 1 ELSE 0 END",
        ),
    },
)
_clause(
    "clause_pair_guards",
    {
        "inflated": (lambda: guards.modal_inflation(F.col("s"), F.concat(F.col("t"), F.lit(" 必须"))), r"regexp_matches(s, '(?i)\bshould\b|\brecommended\b|\bmay be\b') AND NOT regexp_matches(s, '(?i)\bshall\b|\bmust\b|\brequired\b')"),
        "foreign": (
            lambda: _csv(guards.foreign_standards(F.col("t"), F.col("s"))),
            r"array_to_string(list_filter(regexp_extract_all(t, '(?i)\b(?:EN|IEC|ISO|CEN|CENELEC|IEEE|ITU|NBR|ABNT|WELMEC|OIML)(?:\s?ISO)?\s?\d{2,6}(?:-\d{1,3})*\b'), lambda x, i: NOT list_contains(list_transform(regexp_extract_all(s, '(?i)\b(?:EN|IEC|ISO)(?:\s?ISO)?\s?\d{2,6}'), lambda y: regexp_extract(y, '\d{2,6}')), regexp_extract(x, '\d{2,6}'))"
            r" AND list_position(list_transform(regexp_extract_all(t, '(?i)\b(?:EN|IEC|ISO)(?:\s?ISO)?\s?\d{2,6}'), lambda y: regexp_extract(y, '\d{2,6}')), regexp_extract(x, '\d{2,6}')) = i), '|')",
        ),
        "left": (
            lambda: guards.values_left_behind(F.lit("first"), F.col("s"), F.col("t")),
            r"CASE WHEN starts_with(s, 'first') THEN CASE WHEN len(list_filter(list_distinct(['200', '1008', regexp_extract(s, '(\d+),', 1)]), lambda x: true)) >= 4 THEN 4 ELSE 0 END ELSE 0 END",
        ),
        "risk": (
            lambda: _csv(guards.pairing_risk(F.col("s"), F.col("s"), F.lit(False))),
            r"CASE WHEN contains(s, ' 5 V or 6 V') THEN 'v' WHEN starts_with(s, 'Temperature range') AND regexp_extract(s, 'to (\d+) ', 1) <> '25' THEN '°c' ELSE '' END",
        ),
    },
    "pairs",
)
_clause(
    "clause_catalog",
    {
        "profiles": (
            lambda: _csv(catalog.variant_tokens(F.lit(""), F.col("s"))),
            _list(_ordered(r"list_transform(list_zip(regexp_extract_all(replace(s, ' ', '  '), '(?:^|[^A-Za-z0-9])([A-Z]{1,4})[-_]?(\d{1,3})(?:$|[^A-Za-z0-9])', 1), regexp_extract_all(replace(s, ' ', '  '), '(?:^|[^A-Za-z0-9])([A-Z]{1,4})[-_]?(\d{1,3})(?:$|[^A-Za-z0-9])', 2)), lambda x: x[1] || x[2])")),
        ),
        "periods": (
            lambda: _csv(catalog.periods(F.col("s"))),
            _list(
                r"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(replace(s, ' ', '  '), '(?i)(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)?)\s*-?\s*(?:s|sec(?:ond)?s?|min(?:ute)?s?|h(?:our)?s?|days?|months?)', 1), regexp_extract_all(replace(s, ' ', '  '), '(?i)(?:^|[^A-Za-z0-9])\d+(?:\.\d+)?\s*-?\s*(s|sec(?:ond)?s?|min(?:ute)?s?|h(?:our)?s?|days?|months?)', 1)),"
                r" lambda x: x[1] || ' ' || CASE WHEN lower(x[2]) IN ('min', 'minute', 'minutes') THEN 'min' WHEN lower(x[2]) IN ('h', 'hour', 'hours') THEN 'h' WHEN lower(x[2]) IN ('day', 'days') THEN 'day' WHEN lower(x[2]) IN ('s', 'sec', 'secs', 'second', 'seconds') THEN 's' ELSE lower(x[2]) END)))"
            ),
        ),
        "measures": (
            lambda: F.array_join(F.transform(F.filter(catalog.constraints_by_unit(F.col("s")), lambda p: p["unit"].isin("v", "°c", "bar")), lambda p: F.concat_ws("=", p["unit"], p["value"])), "|"),
            _list(
                r"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(replace(s, ' ', '  '), '(?i)(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)?)\s*(V|°C|bar)(?:$|[^A-Za-z])', 2), regexp_extract_all(replace(s, ' ', '  '), '(?i)(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)?)\s*(V|°C|bar)(?:$|[^A-Za-z])', 1)), lambda x: lower(x[1]) || '=' || x[2])))"
            ),
        ),
        "proper": (lambda: _csv(catalog.proper_tokens(F.col("s"))), _list(r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*'), lambda x: regexp_matches(substr(x, 2), '[A-Z]') OR regexp_full_match(x, '[A-Z][A-Z0-9]+')), lambda x: lower(x))))")),
        "subject": (
            lambda: catalog.event_subject(F.col("s")),
            "CASE WHEN starts_with(s, 'Low battery') THEN 'lowbatteryevent' WHEN starts_with(s, 'Firmware') THEN 'firmwareimagetransferwithevent' WHEN starts_with(s, 'The clock') THEN 'andverylongpowerfailureevent' ELSE '' END",
        ),
        "role": (
            lambda: catalog.lifecycle_role(F.lit(""), F.col("s")),
            r"CASE WHEN regexp_matches(s, '^The meter shall record') THEN 'store' WHEN contains(s, 'archive') THEN 'store' WHEN regexp_matches(s, '^Low battery event') THEN 'report' WHEN contains(s, '采集') THEN 'collect' WHEN starts_with(s, 'Load control') THEN 'execute' WHEN starts_with(s, 'query') THEN 'query' WHEN starts_with(s, 'Set up') THEN 'configure' WHEN s = 'Access/ R /W' THEN 'access' ELSE 'behavior' END",
        ),
    },
)
_clause(
    "clause_pair_variants",
    {
        "compatible": (
            lambda: catalog.periods_compatible(F.col("s"), F.col("s")),
            "true",
        ),
        "conflict": (
            lambda: catalog.variants_conflict(F.col("s"), F.col("t")),
            r"list_sort(list_distinct(regexp_extract_all(s, '\d+'))) <> list_sort(list_distinct(regexp_extract_all(t, '\d+'))) OR list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*'), lambda x: regexp_matches(substr(x, 2), '[A-Z]') OR regexp_full_match(x, '[A-Z][A-Z0-9]+')), lambda x: lower(x))))"
            r" <> list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9]*'), lambda x: regexp_matches(substr(x, 2), '[A-Z]') OR regexp_full_match(x, '[A-Z][A-Z0-9]+')), lambda x: lower(x))))",
        ),
    },
    "pairs",
)
_clause(
    "clause_labels",
    {
        "labels": (
            lambda: _csv(records.labels(F.col("s"))),
            r"coalesce(nullif(concat_ws('|', CASE WHEN regexp_matches(lower(s), 'secur| key|key |cipher|encrypt|auth|hls|lls|certificate|integrity') THEN '安全' END, CASE WHEN regexp_matches(lower(s), 'firmware|image transfer|upgrade') THEN '升级' END, CASE WHEN regexp_matches(lower(s), 'disconnect|relay|load control') THEN '负控' END,"
            r" CASE WHEN regexp_matches(lower(s), 'tariff|rate ') THEN '费率' END, CASE WHEN regexp_matches(lower(s), 'event| log|error|power failure') THEN '事件记录' END, CASE WHEN regexp_matches(lower(s), 'register|energy|current') THEN '计量' END, CASE WHEN regexp_matches(lower(s), 'clock|time sync') THEN '时钟' END,"
            r" CASE WHEN regexp_matches(lower(s), 'dlms|cosem|obis|sap|script|set ') THEN '通信协议' END), ''), '通信协议')",
        ),
        "name": (
            lambda: records.object_name(F.array().cast("array<struct<type:string,name:string>>"), F.col("s")),
            rf"CASE WHEN string_split(trim(regexp_extract({_CLEAN.format('s')}, '\b([A-Z][A-Za-z0-9_/-]*(?:\s+[A-Z][A-Za-z0-9_/-]*){{0,4}})\b', 1)), ' ')[1] IN ('A', 'An', 'For', 'If', 'In', 'It', 'Numbers', 'O', 'Only', 'Table', 'The', 'This', 'To', 'You') THEN '' ELSE trim(regexp_extract({_CLEAN.format('s')}, '\b([A-Z][A-Za-z0-9_/-]*(?:\s+[A-Z][A-Za-z0-9_/-]*){{0,4}})\b', 1)) END",
        ),
        "tags": (lambda: _csv(records.merged_tags(F.array(F.lit("a"), F.lit("")), F.array(F.when(F.col("id") % 2 == 0, "b"), F.lit("a")))), "CASE WHEN id % 2 = 0 THEN 'a|b' ELSE 'a' END"),
        "reason": (
            lambda: records.excluded_reason(F.col("s"), F.when(F.col("id") % 5 == 0, "heading").otherwise("paragraph"), F.when(F.col("id") % 7 == 0, "front_matter"), F.col("id") % 11 == 0, F.col("id") % 13 == 0),
            r"CASE WHEN id % 13 = 0 THEN 'expert_non_requirement' WHEN id % 11 = 0 THEN 'noise' WHEN id % 7 = 0 THEN 'non_body' WHEN id % 5 = 0 THEN 'heading' WHEN trim(s) = '' THEN 'empty' WHEN regexp_matches(trim(s), '(?i)^(EN|IEC|ISO|CEN|CENELEC|ETSI|IEEE|ITU)[\s/–-]?\d') THEN 'reference' WHEN regexp_matches(trim(s), '^\d+(\.\d+)*\s+[A-Za-z][A-Za-z /\-]{0,40}$') THEN 'heading' ELSE 'not_candidate' END",
        ),
    },
)
_NORM = r"regexp_matches(s, '(?i)\bshall\b|\bmust\b|\bshould\b|\brequired\b|必须|不得')"
_clause(
    "clause_dispositions",
    {
        "disposition": (
            lambda: records.base_disposition(F.col("s"), F.when(F.col("id") % 3 == 0, "header").otherwise("data"), F.when(F.col("id") % 2 == 0, "cell").when(F.col("id") % 5 == 0, "row").otherwise("context"), F.lit("No."), F.col("id") % 17 == 0, F.col("id") % 19 == 0, F.when(F.col("id") % 23 == 0, "weak_signal"))["disposition"],
            rf"CASE WHEN id % 17 = 0 THEN 'excluded' WHEN id % 19 = 0 THEN 'review' WHEN s IN ('不适用', 'n/a') THEN 'excluded' WHEN id % 23 = 0 THEN 'review' WHEN regexp_full_match(s, '\d+') THEN 'excluded'"
            rf" WHEN {_NORM} OR starts_with(s, 'Temperature range') THEN CASE WHEN id % 2 = 0 THEN 'target' WHEN id % 5 = 0 THEN 'composite' ELSE 'review' END WHEN id % 3 = 0 THEN 'context' WHEN id % 2 = 0 OR id % 5 = 0 THEN 'composite' ELSE 'context' END",
        ),
        "risk": (
            lambda: records.review_risk(F.when(F.col("id") % 3 == 0, "security").when(F.col("id") % 3 == 1, "event").otherwise("functional"), (F.col("id") % 10) / 10, F.col("id") % 4 == 0, ("security",), ("event",)),
            "CASE WHEN id % 3 = 0 THEN 'mandatory_review' WHEN id % 3 = 1 OR id % 10 < 8 OR id % 4 = 0 THEN 'high_risk' ELSE 'low_risk' END",
        ),
        "decision": (
            lambda: records.stub_review(F.col("id").cast("string"), F.lit("functional"), (F.col("id") % 10) / 10, F.col("id") % 4 == 0, ("security",), ("event",))["decision"],
            "CASE WHEN id % 10 < 8 OR id % 4 = 0 THEN 'needs_expert' ELSE 'accept' END",
        ),
        "review": (
            lambda: records.should_review(F.when(F.col("id") % 6 == 0, "security").otherwise("x"), F.when(F.col("id") % 5 == 0, "table").otherwise("text"), (F.col("id") % 10) / 10, F.col("id") % 4 == 0, ("security",), ("table",)),
            "id % 4 = 0 OR id % 10 < 8 OR id % 6 = 0 OR (id % 5 = 0 AND id % 10 < 9)",
        ),
        "outcome": (
            lambda: records.final_outcome(F.when(F.col("id") % 4 == 0, "fail").otherwise("pass"), F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "invalid_llm_code_drift").when(F.col("id") % 5 == 2, "confirmed_issue").when(F.col("id") % 5 == 3, "not_an_issue").otherwise("?")),
            "CASE WHEN id % 4 = 0 THEN 'hard_veto' WHEN id % 5 = 0 THEN 'rules_only_suspect' WHEN id % 5 = 1 THEN 'llm_vote_invalid' WHEN id % 5 = 2 THEN 'llm_confirmed_issue' WHEN id % 5 = 3 THEN 'llm_cleared' ELSE 'llm_uncertain' END",
        ),
    },
)
