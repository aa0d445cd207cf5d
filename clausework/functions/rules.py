"""Row rules: predicates, classes and cascades over one text, each a column expression that stays in generated code.

Texts are single lines or sentences; null counts as the empty text where a rule says nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.text import any_of

# fixed values
SIGNALS = ("shall", "must", "should", "required", "requirement", "not used, must", "is required", "are required", "only", "mandatory")
ATOMIC_SIGNALS = ("shall", "must", "not used, must", "is required", "are required", "access is required", "mandatory", "required by", "required for", "set to")
AMBIGUOUS = ("if necessary", "can be", "may be", "where applicable", "reserved")
DEFINING = (
    r"\balways\s+begins\b",
    r"\balways\s+ends\b",
    r"\bends\s+on\b",
    r"\bcan\s+be\s+valid\s+for\b",
    r"\bvalid for\b[^.;:]*\b\d+\b[^.;:]*\b(day|days|month|months|year|years|hour|hours)\b",
    r"\b(?:default|factory)\s+value\s+of\b",
    r"\bcan\s+be\s+one\s+of\b",
    r"\b(?:profile|protocol|channel|medium|media)\b[^.;:]{0,120}\bcan\s+be\s+used\s+for\s+(?:the\s+)?communication\b",
    r"\bat\s+least\b[^.;:]{0,80}\b(?:highlight|record|report|transmit|store)s?\b[^.;:]{0,120}\bif\b",
)
MARKERS = ("x", "yes", "true", "required", "mandatory", "applicable")
MODAL = r"(?i)\bshall\b|\bmust\b|\bshould\b|\brequired\b|\bmandatory\b|应当|必须|不得|应满足|应支持|须符合"
PATTERN = (
    r"(?i)\bcan\s+be\s+(?:valid\s+for|one\s+of|assigned|used\s+for)\b|\b(?:default|factory)\s+value\s+of\b"
    r"|\balways\s+(?:begins|ends)\b|\bends\s+on\b|\bvalid\s+for\b[^.;:]*\b\d+\b[^.;:]*\b(?:day|days|month|months|year|years|hour|hours)\b"
)
COLON_SPEC = r"^[A-Za-z][^:\d]{2,60}:\s+(?:\S*\d|[IVX]{1,6}\b|[A-Z]{2,}\b).*$"
SPEC_LABEL = (
    r"(?i)\b(?:accuracy|battery|capacity|class|consumption|current|degree|dimensions?|frequency|humidity|ingress|insulation|lifetime|mass|power"
    r"|protection|range|rating|resolution|service\s+life|supply|temperature|tolerance|voltage|weight)\b"
)
SPEC_VALUE = r"(?i)\d[\d.,]*(?:\s*(?:%|A|Ah|dB|g|h|Hz|kg|m|mm|ms|s|V|VA|W|Wh|day|days|hour|hours|month|months|year|years|°C))?\b|IP\d{2,3}\b|[IVX]{1,6}\b"
METADATA_LABEL = r"(?i)^\s*(?:approval|approved\s+by|author|date|document|owner|reference|revision|status)\s*$"
NON_FUNCTIONAL = ("accuracy", "precision", "reliability", "mtbf", "failure rate", "temperature range", "ip5", "ip6", "response time", "latency", "timeout", "throughput")
CAPACITY = ("storage capacity", "record retention", "retention period", "number of records")
CAPACITY_PATTERN = r"(?i)\b(?:at least|minimum of|max(?:imum)?(?:\s+of)?)\s+\d+\s+(?:\w+\s+){0,3}(?:records?|entries|periods|days?|intervals?|profiles?|objects?|associations?)\b"
CONSTRAINTS = ("shall not", "must not", "only be", "limited to", "reserved")
NOISE_PATTERNS = (r"^\d+\s+pages?$", r"^[ivxlcdm]+$", r"^\d+$")
CAPTION = r"(?i)^(table|figure)\s+\d+\b"
NUMBERED = r"^(\d+(?:\.\d+)*)(?:\s+|\.\s+)(.{3,})$"
REFERENCE_LINE = r"(?i)^(?:EN|IEC|ISO|CEN|CENELEC|ETSI|IEEE|ITU)[\s/–-]?\d"
HEADING_LINE = r"^\d+(?:\.\d+)*\s+[A-Za-z][A-Za-z /\-]{0,40}$"
CONNECTORS = ("if", "when", "unless", "in case", "where", "depending on", "either", "or", "otherwise")
MODAL_VERBS = ("shall", "must", "will", "may", "should", "need to")
QUALIFIERS = (
    (("不可更换", "non-replaceable", "not replaceable"), ("可更换", "replaceable")),
    (("非可选", "mandatory", "required"), ("可选", "optional")),
    (("禁止", "不得", "must not", "shall not"), ("允许", "may", "permitted")),
    (("正向", "进口", "import"), ("反向", "出口", "export")),
    (("本地", "local"), ("远程", "remote")),
)
DOMAINS = (
    ("communication_profile", ("communication profile", "plc", "prime", "wi-sun", "lorawan", "rf", "network", "media of communication")),
    ("security_policy", ("security", "authenticated", "authentication", "encrypted", "encryption", "hls", "password", "key agreement", "digital signature", "aes-gcm", "ecdsa", "ecdh")),
    ("association", ("association", "sap", "logical device", "client", "server application")),
    ("obis_code", ("obis", "logical name", "code obis")),
    ("cosem_object", ("cosem", "interface class", "class_id", "attribute", "method")),
    ("event", ("event", "events", "event log", "group/subgroup")),
    ("alarm", ("alarm", "alarms")),
    ("error", ("error", "errors")),
    ("register", ("register", "energy register", "demand register")),
    ("billing_profile", ("billing", "periods of billing", "billing profile")),
    ("load_profile", ("load profile", "load curve")),
    ("firmware_update", ("firmware", "update of firmware")),
    ("meter_function", ("smart electricity meter", "meter", "measurement", "measuring")),
    ("power_quality", ("power quality", "qee", "quality of energy", "voltage", "current")),
    ("data_model", ("data model", "objects", "abstract object", "object related")),
)


#: Words of which one stands wherever the pattern finds something; looked for first, as most lines have none.
MODAL_HINTS = ("shall", "must", "should", "required", "mandatory", "应当", "必须", "不得", "应满足", "应支持", "须符合")
PATTERN_HINTS = ("can", "value", "always", "ends", "valid")


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _has_modal(v: Column) -> Column:
    return any_of(F.lower(v), MODAL_HINTS) & v.rlike(MODAL)


def _has_pattern(v: Column) -> Column:
    return any_of(F.lower(v), PATTERN_HINTS) & v.rlike(PATTERN)


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One pattern that finds what any of them finds, so that a text is scanned once."""
    return "|".join(f"(?:{p})" for p in patterns)


def term_pattern(terms: tuple[str, ...]) -> str:
    """Finds one of the terms, or its plural, that no letter or digit touches; for lower-case text."""
    plain = "|".join(t.replace("/", "\\/").replace("-", "\\-") for t in terms)
    return f"(?:^|[^a-z0-9])(?:{plain})(?:e?s)?(?:[^a-z0-9]|$)"


def is_noise(text: Column, patterns: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> Column:
    """Empty lines, page counts, roman numerals, bare numbers, and what a document profile adds."""
    low = F.lower(_v(text))
    found = (low == "") | low.rlike(any_pattern(NOISE_PATTERNS + patterns))
    return found | F.rtrim(low, F.lit(":")).isin(*exact) if exact else found


def is_toc_entry(text: Column) -> Column:
    return _v(text).rlike(r"\s+\d{1,3}$") | F.endswith(F.lower(_v(text)), F.lit("page"))


def is_caption(text: Column) -> Column:
    return F.trim(_v(text)).rlike(CAPTION)


def heading_level(text: Column) -> Column:
    """Level 1 to 6 of a numbered line; null for quantities over 40, contents entries, captions and noise."""
    number = F.regexp_extract(_v(text), NUMBERED, 1)
    title = F.trim(F.regexp_extract(_v(text), NUMBERED, 2))
    bare = ~F.contains(number, F.lit(".")) & (F.coalesce(F.try_to_number(number, F.lit("999999999")), F.lit(99)) > 40)
    plain = (number == "") | bare | is_toc_entry(title) | is_caption(text) | is_noise(text)
    return F.when(~plain, F.least(F.lit(6), F.size(F.split(number, "\\."))))


def is_requirement_like(text: Column) -> Column:
    low = F.lower(_v(text))
    return ~F.startswith(F.trim(low), F.lit("summary")) & (any_of(low, SIGNALS) | low.rlike(any_pattern(DEFINING)))


def is_atomic_like(text: Column) -> Column:
    return any_of(F.lower(_v(text)), ATOMIC_SIGNALS)


def is_ambiguous(text: Column) -> Column:
    return any_of(F.lower(_v(text)), AMBIGUOUS)


def header_part(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_v(text))), r"[\s_\-]+", " ")


def is_marker(text: Column) -> Column:
    return header_part(text).isin(*MARKERS)


def obligation_signal(text: Column) -> Column:
    """marker, modal, pattern, colon_spec, sentence_shape or none; the first that holds."""
    v = _v(text)
    sentence = v.rlike(r"[.!?。！？]\s*$") & (F.size(F.filter(F.split(v, r"\s+"), lambda x: x != "")) >= 5)
    return (
        F.when(F.trim(v) == "", "none")
        .when(is_marker(v), "marker")
        .when(_has_modal(v), "modal")
        .when(_has_pattern(v), "pattern")
        .when(F.trim(v).rlike(COLON_SPEC), "colon_spec")
        .when(sentence, "sentence_shape")
        .otherwise("none")
    )


def _spec(text: Column) -> tuple[Column, Column, Column]:
    v = F.trim(_v(text))
    return v.rlike(COLON_SPEC), F.regexp_extract(v, "^([^:]*):", 1), F.regexp_extract(v, r"^[^:]*:\s+(.*)$", 1)


def is_technical_spec(text: Column) -> Column:
    is_spec, label, value = _spec(text)
    return is_spec & label.rlike(SPEC_LABEL) & value.rlike(SPEC_VALUE)


def is_metadata_spec(text: Column) -> Column:
    is_spec, label, _ = _spec(text)
    return is_spec & label.rlike(METADATA_LABEL)


def is_normative(text: Column) -> Column:
    """Signal modal or pattern, or a technical specification; no marker. Each pattern is tried once."""
    v = _v(text)
    technical = F.contains(v, F.lit(":")) & is_technical_spec(v)
    return (_has_modal(v) | _has_pattern(v) | technical) & ~is_marker(v)


def is_coverage_candidate(text: Column, kind: Column, region: Column, noise: Column) -> Column:
    """Requirement-like body text that is no heading, heading line or short line of a standard's number."""
    v = F.trim(_v(text))
    body = ~F.coalesce(noise, F.lit(False)) & (F.coalesce(F.nullif(region, F.lit("")), F.lit("body")) == "body") & (_v(kind) != "heading")
    return is_requirement_like(text) & body & (v != "") & ~((F.length(v) <= 160) & v.rlike(REFERENCE_LINE)) & ~v.rlike(HEADING_LINE)


def domain_tags(text: Column, low: Column | None = None) -> Column:
    """Tags of all rules that find a term, in rule order. low: the text in lower case as a column, which saves making it for every term."""
    low = F.lower(_v(text)) if low is None else low
    # a term is looked for as it stands before its borders are checked: most lines hold none
    return F.array_compact(F.array(*[F.when(any_of(low, terms) & low.rlike(term_pattern(terms)), F.lit(tag)) for tag, terms in DOMAINS]))


def primary_domain(tags: Column) -> Column:
    return F.coalesce(F.get(tags, 0), F.lit("general"))


def requirement_type(text: Column, tags: Column) -> Column:
    low, tagged = F.lower(_v(text)), lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    return (
        F.when(tagged("security") | any_of(low, ("hls", "lls", "password", "encrypt", "authenticat")), "security")
        .when(tagged("access_control") | any_of(low, ("read", "write", "access", "association")), "access_control")
        .when(tagged("communication_profile") | any_of(low, ("dlms", "xdlms", "communication", "push")), "communication")
        .when(tagged("cosem_object") | any_of(low, ("cosem", "obis", "logical_name", "attribute")), "cosem_object")
        .when(tagged("event"), "event")
        .otherwise("functional")
    )


def verification_method(text: Column, tags: Column) -> Column:
    low, tagged = F.lower(_v(text)), lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    check = tagged("configuration_check") | any_of(low, ("set to", "access rights", "configured", "password", "hls", "lls"))
    test = any_of(low, ("shall support", "must support", "service", "push", "notification")) | tagged("security_policy")
    return F.when(check, "configuration_check").when(test, "test").otherwise("inspection")


def requirement_class(text: Column) -> Column:
    low = F.lower(_v(text))
    return F.when(low.rlike(CAPACITY_PATTERN) | any_of(low, NON_FUNCTIONAL + CAPACITY), "non_functional").when(any_of(low, CONSTRAINTS), "constraint").otherwise("functional")


def priority(decision: Column, confidence: Column) -> Column:
    low = F.coalesce(confidence.try_cast("double") < 0.6, F.lit(False))
    return F.when((_v(decision) == "pending") | low, "P2").otherwise("P1")


def status_of(decision: Column) -> Column:
    return F.when(_v(decision) == "accept", "confirmed").otherwise("draft")


def review_questions(text: Column, ambiguous: Column) -> Column:
    one = F.array(F.concat(F.lit("Confirm whether this source text is normative: "), F.substring(_v(text), 1, 140)))
    return F.when(ambiguous, one).otherwise(F.array().cast("array<string>"))


def modal_actions(text: Column) -> Column:
    """Distinct verbs after a modal, sorted."""
    found = F.regexp_extract_all(F.lower(_v(text)), F.lit(rf"\b(?:{'|'.join(MODAL_VERBS)})\s+([a-z]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def connectors(text: Column) -> Column:
    """Distinct condition words, sorted."""
    found = F.regexp_extract_all(F.lower(_v(text)), F.lit(rf"\b(?:{'|'.join(CONNECTORS)})\b"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def qualifier_sides(text: Column) -> list[tuple[Column, Column]]:
    """For each pair of qualifiers whether the text has the left side, and whether it has the right side alone."""
    low = F.lower(_v(text))
    return [(any_of(low, left), any_of(low, right) & ~any_of(low, left)) for left, right in QUALIFIERS]


def opposed(a: Column, b: Column) -> Column:
    """Whether one text has the left and the other the right side of a pair of qualifiers; a text with both counts as left."""
    out = F.lit(False)
    for (al, ar), (bl, br) in zip(qualifier_sides(a), qualifier_sides(b), strict=True):
        out = out | (al & br) | (ar & bl)
    return out


def section_adjacent(a: Column, b: Column) -> Column:
    """Equal sections, siblings whose last numbers differ by one, or sections that share all but the last part."""
    nums = lambda c: F.regexp_extract_all(_v(c), F.lit(r"\d+"), F.lit(0))
    head = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    last = lambda x: F.get(x, F.size(x) - 1).cast("decimal(38,0)")
    x, y = nums(a), nums(b)
    numbered = (F.size(x) >= 2) & (F.size(y) >= 2) & (head(x) == head(y))
    stem = lambda c: F.regexp_replace(_v(c), r"\.[^.]*$", "")
    shared = (stem(a) == stem(b)) & (stem(a) != _v(a))
    return (_v(a) != "") & (_v(b) != "") & ((_v(a) == _v(b)) | F.when(numbered, F.abs(last(x) - last(y)) == 1).otherwise(shared))


def lifecycle(confirmed: Column, implemented: Column, tested: Column, current: Column | None = None) -> Column:
    """draft, confirmed, implemented or verified; never below the current state."""
    names = F.array(*[F.lit(x) for x in ("draft", "confirmed", "implemented", "verified")])
    rank = F.when(~F.coalesce(confirmed, F.lit(False)), 0).when(_v(implemented) != "done", 1).when(~F.coalesce(tested, F.lit(False)), 2).otherwise(3)
    if current is not None:
        rank = F.greatest(rank, F.greatest(F.array_position(names, _v(current)).cast("int") - 1, F.lit(0)))
    return F.get(names, rank)
