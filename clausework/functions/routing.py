"""Routes, owners, labels and patterns: cascades over a unit or a requirement, each rule with its reason."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import records, rules, scalars
from clausework.functions.text import any_of

# fixed values
ATTRIBUTE = r"(?i)\b(?:attribute|attr|method)\s*(?:no\.?\s*)?(\d{1,3})\b"
ACCESS_MODE = r"(?i)\b(?:read[- ]only|write[- ]only|read[- ]write|readonly|readwrite)\b"
PROTOCOL = r"\b(?:DLMS|COSEM)\b"
OBJECT_HEADER = r"(?i)object\s*/\s*attribute\s*name|access\s*rights|^CL$|^#$"
ENGLISH_MODALS = ("shall", "must", "will", "may", "should")
MODAL_PHRASES = ("need to",)
CHINESE_MODAL = "必须|需要|应|须|宜|可(?!能)"
TABLE_KINDS = ("table_row", "table_cell")
VERIFIED_CLASSES = ("1", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "15", "17", "18", "20", "22", "61", "62", "64", "70")
SOFTWARE_TERMS = (
    "dlms", "cosem", "obis", "xdmls", "xdlms", "get service", "set service", "action", "event", "事件", "profile", "曲线", "tariff", "费率", "billing", "结算",
    "prepaid", "预付费", "push", "p1", "display", "显示", "status word", "状态字", "upgrade", "升级", "clock", "时钟", "access right", "访问权限",
)
HARDWARE_TERMS = (
    "计量芯片", "芯片型号", "ct采样", "ct 采样", "锰铜", "shunt", "relay physical", "继电器物理", "电源", "电池", "frequency band", "频段", "mechanical", "结构尺寸", "寿命", "器件",
    "硬件更换", "manufacturer", "manufactures a device", "battery", "service life", "lifetime", "enclosure", "housing", "ingress protection", "power consumption", "power supply",
    "three-phase", "powered from all three phases", "va",
)
SHARED_TERMS = (
    "驱动", "hardware related", "硬件相关", "波特率", "baud", "dataflash", "存储容量", "flash", "mbus", "m-bus", "wmbus", "w-mbus", "模块适配", "硬件接口", "采样影响", "继电器状态",
    "mobile data concentrator", "concentrator function", "concentrator functions", "walk by", "walk-by", "drive by", "drive-by", "remote management center",
    "central hardware and software components",
)
HARDWARE_CONTEXT = ("型号", "芯片", "器件", "物理", "结构", "材质", "规格", "封装", "引脚", "硬件")
SOFTWARE_ACTIONS = ("读取", "同步", "记录", "配置", "处理", "上报", "控制", "管理", "计算", "更新", "校准", "实现", "支持")
CONTEXT_RADIUS = 12
PROFILE_WORDS = ("load profile", "load curve", "mass memory", "capture period", "storage capacity")
NETWORK_WORDS = ("smtp", "m-bus", "gprs", "tcp", "udp", "ipv4", "ipv6", "communication")
DOMAIN_LABELS = (
    ("结算", ("billing", "settlement", "invoicing", "period")), ("时钟", ("time", "clock", "rtc")), ("事件记录", ("event", "log")),
    ("安全", ("security", "auth", "cipher", "key", "hls", "lls")), ("需量", ("demand",)), ("费率", ("tariff", "rate")), ("Push", ("push",)),
    ("升级", ("firmware", "upgrade", "image transfer")), ("曲线", ("load profile", "mass memory", "collection", "capture period", "storage capacity")),
    ("计量", ("metering", "energy", "register", "measurement", "voltage", "current")), ("通信协议", ("dlms", "cosem", "xdlms", "association", "service")),
)
MODULE_OF_DOMAIN = {"结算": "billing", "时钟": "time", "事件记录": "events", "安全": "security", "需量": "demand", "费率": "tariff", "Push": "push", "升级": "firmware", "曲线": "load_profile", "计量": "metering", "通信协议": "communication", "状态字": "status"}
STATUS_BIT = r"(?i)\bBit\s+(\d+)\s+([A-Z][A-Z0-9_-]*)\s*\|\s*([^:|]+?)\s*:\s*This bit is set to indicate that\s+(.+?)\s*\.?$"
STANDARDS = r"(?i)\b(?:IEC|ISO|ABNT|NBR|EN|IEEE)\s*\d{3,6}(?:-\d+)*(?::\d{4})?\b"
TERM_SHAPES = (r"\b[A-Z][A-Z0-9]{1,}(?:/[A-Z0-9]{2,})+\b", r"\b[A-Z]{2,}(?:-[A-Z0-9]{2,})+\b")
ACRONYM = r"\b[A-Z]{2,8}\b"
PHRASE = r"\b(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,}|of|and|for)){1,5}\b"
TERM_STOPWORDS = ("THE", "AND", "FOR", "WITH", "THIS", "THAT", "FROM", "TABLE", "FIGURE", "STANDARD", "BRAZILIAN", "REQUIREMENTS")


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hard_structure(text: Column, roles: Column, headers: Column) -> Column:
    """Whether a unit holds checkable structure: an object code, a known class, an object table, or, within one, an attribute or access mode."""
    v = _v(text)
    p = records.parameters(v)
    table = F.array_contains(roles, "cosem_structured") | F.exists(headers, lambda h: h.rlike(OBJECT_HEADER))
    known = F.exists(F.slice(p["class_ids"], 1, 4), lambda c: c.isin(*VERIFIED_CLASSES))
    return (F.size(p["obis_codes"]) > 0) | known | table


def obliges(text: Column) -> Column:
    """Whether a unit holds a modal or a strong pattern."""
    v, signal = _v(text), rules.obligation_signal(text)
    words = "|".join(ENGLISH_MODALS + MODAL_PHRASES)
    return v.rlike(rf"(?i)\b(?:{words})\b") | v.rlike(CHINESE_MODAL) | signal.isin("modal", "marker", "pattern")


def unit_route(text: Column, kind: Column, roles: Column, headers: Column, disposition: Column) -> Column:
    """(route, rule, confidence) of a unit, the first of eleven rules that holds. Structure goes one way, prose the other."""
    a, b = hard_structure(text, roles, headers), obliges(text)
    weak = rules.obligation_signal(text).isin("sentence_shape", "colon_spec")
    d, table = _v(disposition), kind.isin(*TABLE_KINDS)
    objects = table & (F.array_contains(roles, "cosem_structured") | F.exists(headers, lambda h: h.rlike(OBJECT_HEADER)))
    given = table & ~d.isin("", "target") & (a | b)
    one = lambda route, rule, c: F.struct(F.lit(route).alias("route"), F.lit(rule).alias("rule"), F.lit(c).alias("confidence"))
    return (
        F.when(kind.isin("definition", "reference", "heading"), one("context", "context_by_kind", 0.9))
        .when(given & (d == "composite"), one("a_track", "table_composition_a_authority", 0.9))
        .when(given, one("context", "context_by_disposition", 0.95))
        .when(objects & (a | b), one("a_track", "cosem_table_a_priority", 0.9))
        .when(a & b, one("mixed", "hard_ab_mixed", 0.95))
        .when(a, one("a_track", "hard_a_only", 1.0))
        .when(b, one("b_track", "hard_b_only", 1.0))
        .when((kind == "narrative") | F.array_contains(roles, "excluded"), one("context", "context_by_kind", 0.9))
        .when(F.array_contains(roles, "review_candidate"), one("review", "review_disposition", 0.4))
        .when(weak, one("review", "review_weak_signal", 0.4))
        .when(F.array_contains(roles, "context") | (d == "context"), one("context", "context_by_disposition", 0.9))
        .otherwise(one("review", "review_no_signal", 0.4))
    )


def _named(text: Column, term: str) -> Column:
    """Whether a term stands in a lower-case text: Latin ones as whole words; short CJK ones not amid hardware words without an action."""
    if term.isascii():
        return F.contains(text, F.lit(term)) & text.rlike(rf"(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])")
    if len(term) > 2 or not re.search("[一-鿿]", term):
        return F.contains(text, F.lit(term))
    # every place with what stands around it, by cutting the text at the term
    parts, n = F.split(text, term, -1), len(term)

    def around(_: Column, i: Column) -> Column:
        end = _end(parts, i, n)
        start = F.greatest(F.lit(0), end - CONTEXT_RADIUS)
        return F.substr(text, start + 1, end + n + CONTEXT_RADIUS - start)

    places = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), around)
    real = F.exists(places, lambda p: ~any_of(p, HARDWARE_CONTEXT) | any_of(p, SOFTWARE_ACTIONS))
    return F.contains(text, F.lit(term)) & real


def _end(parts: Column, i: Column, n: int) -> Column:
    """Length of the text before the i-th cut."""
    return F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * n


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first term of the list that the text names; null for none."""
    low = F.lower(_v(text))
    out = F.lit(None).cast("string")
    for term in reversed(terms):
        out = F.when(_named(low, term), term).otherwise(out)
    return out


def ownership(text: Column) -> Column:
    """(owner, confidence, term): co_design, hardware or software by the terms named; software by default."""
    shared, hard, soft = (first_term(text, t) for t in (SHARED_TERMS, HARDWARE_TERMS, SOFTWARE_TERMS))
    one = lambda who, c, term: F.struct(F.lit(who).alias("owner"), F.lit(c).alias("confidence"), term.alias("term"))
    return F.when(shared.isNotNull(), one("co_design", 0.78, shared)).when(hard.isNotNull() & soft.isNull(), one("hardware", 0.82, hard)).when(soft.isNotNull(), one("software", 0.8, soft)).otherwise(one("software", 0.55, F.lit(None).cast("string")))


def section_title(path: Column) -> Column:
    """The last part of a section path without its number, 80 characters at most."""
    last = F.trim(F.coalesce(F.get(path, F.size(path) - 1), F.lit("")))
    bare = F.trim(F.regexp_replace(last, r"^\d+(?:\.\d+)*\s+", ""))
    return F.substring(F.when(bare != "", bare).otherwise(last), 1, 80)


def domain_label(kind: Column, domain: Column, obj: Column, text: Column, path: Column) -> Column:
    section = F.lower(section_title(path))
    all_ = F.lower(F.concat_ws(" ", _v(domain), _v(obj), _v(text), section))
    service = F.contains(F.lower(F.concat_ws(" ", _v(text), section_title(path))), F.lit("xdlms service"))
    profile = (F.lower(_v(domain)) == "load_profile") | any_of(all_, PROFILE_WORDS)
    out = F.when(kind.isin("event_definition", "event_group_retention"), "事件记录").when(service, "通信协议").when(_v(text).rlike(STATUS_BIT), "状态字").when(profile, "曲线").when(F.contains(all_, F.lit("security")), "安全").when(any_of(all_, NETWORK_WORDS), "通信协议")
    for label, words in DOMAIN_LABELS:
        out = out.when(any_of(all_, words), label)
    return out.otherwise("通信协议")


def module_label(domain: Column, label: Column, text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in MODULE_OF_DOMAIN.items() for x in pair))
    service = F.contains(F.lower(_v(text)), F.lit("xdlms service"))
    profile = (F.lower(_v(domain)) == "load_profile") | any_of(F.lower(_v(text)), PROFILE_WORDS)
    return F.when((label == "状态字") | _v(text).rlike(STATUS_BIT), "status").when(service, "communication").when(profile, "load_profile").otherwise(F.coalesce(F.try_element_at(names, label), F.lit("general")))


def low_information(text: Column, kind: Column, has_attribute: Column, subject_header: Column, predicate_header: Column) -> Column:
    """Rows that say nothing by themselves: attribute rows, boilerplate, unused bits, counted values."""
    t = F.regexp_replace(F.trim(F.regexp_replace(_v(text), r"\s+", " ")), r"\.+$", "")
    low = F.lower(t)
    boiler = F.contains(low, F.lit("functionality")) & F.contains(low, F.lit("objects in support")) & F.contains(low, F.lit("implemented as defined"))
    counted = t.rlike(r"(?i)^(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+shall\s+support\s+Value$")
    headed = (kind == "capability_matrix") & (F.trim(_v(subject_header)) == "#") & (F.lower(F.trim(_v(predicate_header))) == "value")
    return (t != "") & (((kind == "cosem_object") & has_attribute) | boiler | t.rlike(r'(?i)^\d+\s*\|\s*not used,\s*must be set to "?0"?$') | (counted & (kind.isin("functional", "cosem_object") | headed)))


def rendered(template: str, source: Column) -> Column:
    """A template whose {paths} are looked up in a JSON object; missing ones are empty."""
    parts = [F.lit(p) if i % 2 == 0 else F.coalesce(F.get_json_object(source, "$." + p.strip()), F.lit("")) for i, p in enumerate(re.split(r"\{([^{}]+)\}", template))]
    return F.trim(F.concat(*parts))


def pattern_matches(source: Column, trigger: dict) -> Column:
    """Whether a JSON object has a trigger's source type, its required paths (not empty) and its equal fields."""
    at = lambda p: F.get_json_object(source, "$." + p)
    out = F.lit(True)
    if trigger.get("source_type"):
        out = out & (at("source_type") == trigger["source_type"])
    for path in trigger.get("required_fields", ()):
        out = out & at(path).isNotNull() & ~at(path).isin("", "false", "0", "[]", "{}")
    for path, value in trigger.get("field_equals", {}).items():
        out = out & (at(path) == str(value))
    return F.coalesce(out, F.lit(False))


def applied_patterns(source: Column, patterns: list[dict]) -> Column:
    """(pattern_id, requirement_type, object, requirement, confidence) of each pattern that a JSON object meets, in order."""
    one = lambda p: F.struct(F.lit(p["pattern_id"]).alias("pattern_id"), F.lit(p.get("domain_type") or p["pattern_id"]).alias("requirement_type"), rendered(p.get("object", ""), source).alias("object"), rendered(p.get("template", ""), source).alias("requirement"), F.lit(float(p.get("default_confidence", 0.75))).alias("confidence"))
    return F.array_compact(F.array(*(F.when(pattern_matches(source, p.get("trigger", {})), one(p)) for p in patterns)))


def candidate_terms(text: Column) -> Column:
    """All candidate terms of a text, repeats kept: standards, compounds, acronyms but stop words, runs of capitalised words over five letters."""
    t = F.translate(_v(text), "–—", "--")
    found = lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    acronyms = F.filter(found(ACRONYM), lambda x: ~x.isin(*TERM_STOPWORDS))
    return F.concat(found(STANDARDS), *(found(p) for p in TERM_SHAPES), acronyms, F.filter(found(PHRASE), lambda x: F.length(x) > 5))


def drift_of_codes(made: Column, source: Column) -> Column:
    return F.array_sort(F.array_except(scalars.codes(made), scalars.codes(source)))


def safe_title(title: Column, basis: Column) -> Column:
    """Whether a title names no code and no integer that its rows lack."""
    ints = lambda t: F.regexp_extract_all(_v(t), F.lit(r"\d+"), F.lit(0))
    return (F.size(F.array_except(scalars.codes(title), scalars.codes(basis))) == 0) & (F.size(F.array_except(ints(title), ints(basis))) == 0)


def unique_strings(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(_v(x))), lambda x: x != ""))
