"""Expressions over requirement rows, table rows and their fields: identities, fingerprints, verdicts, layouts.

Null texts count as empty. Field maps are map<string,string>; a row's fields keep the order of the map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import rules, scalars
from clausework.functions.text import any_of

# fixed values
NON_MATRIX_KEYS = (
    "id", "name", "#", "object attribute name", "cl", "type", "value", "meaning", "comment", "unit", "flag", "description", "state", "security policy", "bit",
    "security policy security states", "access rights rc pc sc lc", "description of the event", "event number", "number of event", "group number", "subgroup number",
)
COUNT_WORDS = "one two three four five six seven eight nine ten".split()
OBJECT_STOPWORDS = ("A", "An", "For", "If", "In", "It", "Numbers", "O", "Only", "Table", "The", "This", "To", "You")
PREFERRED_TYPES = ("cosem_interface_class", "cosem_object_instance", "object", "client_role", "logical_device", "service_set", "security_level")
CLIENTS = ("RC", "PC", "SC", "LC")
LABELS = (
    ("安全", ("secur", " key", "key ", "cipher", "encrypt", "auth", "hls", "lls", "invocation counter", "integrity", "master key", "protected", "ciphered", "certificate", "esam")),
    ("升级", ("firmware", "image transfer", "image activation", "upgrade")),
    ("负控", ("disconnect", "relay", "load control", "limiter")),
    ("门限范围", ("threshold", "voltage sag", "voltage swell", "limit value")),
    ("节假日", ("special day", "holiday")),
    ("费率", ("tariff", "rate ", "activity calendar", "day profile", "week profile", "season")),
    ("结算", ("billing", "settlement", "end of billing", "mdi reset", "billing reset")),
    ("状态字", ("status word", "status flag", "status bit")),
    ("事件记录", ("event", "logbook", " log", "reboot", "power failure", "power down", "power up", "diagnostic", "error")),
    ("需量", ("demand",)),
    ("计量", ("energy", "metering", "register", "measurement", "active power", "reactive", "apparent", "instantaneous", "cumulative", " import", " export", " wh", "varh", "vah", "power factor", "voltage", "current", "frequency")),
    ("时钟", ("clock", " rtc", "time synchron", "time sync")),
    ("Push", ("push", "datanotification", "notification", "asynchron")),
    ("显示", ("display",)),
    ("通信协议", ("dlms", "cosem", "xdlms", "obis", "association", "sap", "logical device", "profile generic", "script", "schedule", "service", "pull", " get", "set ", "action", "block transfer", "hdlc", "tcp", "gprs", "ppp", "management", "reset")),
)
DEFAULT_LABEL = "通信协议"
TOC_END, TOC_LEADER = r"\.{5,}[\s\d]*$", r"\.{5,}"
OUTLINE = r"(?i)^(?:Annex\s+([A-Z])\b|([A-Z])\.(\d+(?:\.\d+)*)|(\d+(?:\.\d+)*))"
FORMULA_TRIGGERS, NUMERIC_CELL, ACCESS_CELL = r"^[=+\-@\t\r]", r"^[+-]?\d+(?:[.,]\d+)*%?$", r"^[RWAXrwax/\- ]+$"
EVENT_ID = r"G[\w,\s]*?-SG[\w]+-E[\w]+"
NOT_APPLICABLE = r"(?i)^\s*(?:n\s*/?\s*a|not\s+applicable|non[- ]applicable|不适用|不适合)\s*[.!。]?$"
INDEX_HEADER, INDEX_VALUE = r"(?i)^\s*(?:no\.?|number|index|item|序号|编号|项号)\s*$", r"^\s*\d+(?:\.\d+)*[.)]?\s*$"
NOTE_HEADER = r"(?i)note|备注|说明|注释|comment|remark"
DISPOSITION_HEADER = r"(?i)^\s*(?:status|state|result|required|check(?:ed)?|ok|n/?a|remarks?|requirements?|values?|状态|结果|检查|备注)\s*$"
IMPLEMENTED = {"未开始": "not_started", "进行中": "in_progress", "已完成": "done", "done": "done", "complete": "done", "completed": "done"}
REQUIRED_KEYS = ("title", "description", "type", "priority", "module", "labels", "source_quote", "source_section", "source_block_ids", "acceptance_criteria", "dev_guidance", "notes", "status")
LIST_KEYS = ("labels", "source_block_ids", "acceptance_criteria", "dev_guidance")
TEXT_KEYS = ("title", "description", "type", "priority", "module", "source_quote", "source_section", "notes", "status")
DONE_WORDS = ("是", "yes", "Y", "y", "true", "True", "1", "已完成", "done")


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_v(text), F.lit(pattern), F.lit(group))


def _lits(xs) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


# --- normal forms


def match_term(text: Column) -> Column:
    return F.lower(scalars.clean(text))


def plain_title(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(match_term(text), ":+$", ""), r"\s+", " ")


def plain_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_v(text), r"\s+", " ")))


def table_header(text: Column) -> Column:
    """The last part of a path of headers, after the first one where that is not within it."""
    c = scalars.clean(text)
    parts = F.filter(F.transform(F.split(c, "/"), lambda x: F.trim(x)), lambda x: x != "")
    top, leaf = F.get(parts, 0), F.get(parts, F.size(parts) - 1)
    named = F.when(F.contains(rules.header_part(leaf), rules.header_part(top)), leaf).otherwise(F.concat(top, F.lit(": "), leaf))
    return F.when(F.contains(c, F.lit("/")) & (F.size(parts) >= 2), named).otherwise(c)


def event_ids_normal(text: Column) -> Column:
    """Number words within event ids to digits; all other text as it is."""
    v = _v(text)

    def digits(x: Column) -> Column:
        for i, word in enumerate(scalars.NUMBER_WORDS):
            x = F.regexp_replace(x, rf"(?i)(?<![A-Za-z])(E|SG|G){word}(?![A-Za-z])", f"$1{i}")
        return x

    ids = F.concat(F.transform(_all(v, EVENT_ID), digits), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(v, EVENT_ID, -1), ids, lambda a, b: F.concat(a, b)), "")


def formula_safe(value: Column) -> Column:
    """A leading quote for text that a spreadsheet would run, but not for numbers and access codes."""
    return F.when(value.rlike(FORMULA_TRIGGERS) & ~value.rlike(NUMERIC_CELL) & ~value.rlike(ACCESS_CELL), F.concat(F.lit("'"), value)).otherwise(value)


def intish(value: Column) -> Column:
    """A count word up to ten or a number as digits, other text cleaned; null stays null."""
    c = scalars.clean(value)
    at = F.array_position(_lits(COUNT_WORDS), F.lower(c))
    return F.when(value.isNull(), None).when(at > 0, at.cast("string")).when(c.rlike(r"^\d+$"), F.regexp_replace(c, "^0+(?=.)", "")).otherwise(c)


def joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, "; "), F.lit(""))


# --- codes, clauses and objects


def object_code(value: Column) -> Column:
    """One object code: blanks within its groups to points, swapped head signs put right; other text as it is."""
    text = F.trim(F.regexp_replace(_v(value), r"\s+", " "))
    swapped = r"^(\d+):(\d+)-([0-9A-Za-z]+(?:\.[0-9A-Za-z]+){3})$"
    single = lambda t: F.regexp_replace(t, swapped, "$1-$2:$3")
    head, tail = F.substring_index(text, ":", 1), F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    dotted = F.when(F.contains(text, F.lit(":")), F.concat(F.replace(head, F.lit(" "), F.lit("")), F.lit(":"), F.regexp_replace(tail, r"\s+", "."))).otherwise(text)
    compact = F.replace(dotted, F.lit(" "), F.lit(""))
    return F.when(~F.contains(text, F.lit(" ")), single(text)).when(compact.rlike(r"^\d+-\d+:[0-9A-Za-z]+(?:\.[0-9A-Za-z]+){2,3}$"), single(compact)).otherwise(dotted)


def object_codes(value: Column) -> Column:
    """All codes of a cell, cut before each head; empty for an empty cell."""
    text = F.trim(F.regexp_replace(_v(value), r"\s+", " "))
    heads = F.size(_all(text, r"\d+-\d+:"))
    parts = F.when(heads >= 2, F.split(F.regexp_replace(text, r"(\d+-\d+:)", "\x1f$1"), "\x1f")).otherwise(F.array(text))
    return F.filter(F.transform(parts, object_code), lambda x: x != "")


def parameters(text: Column) -> Column:
    """Object codes, access points and class numbers in the text, each once, in order."""
    return F.struct(
        F.array_distinct(_all(text, r"\b\d+-\d+:\d+(?:\.\d+|\.x){3}\b")).alias("obis_codes"),
        F.array_distinct(_all(text, r"\bSAP\s*=\s*0x[0-9A-Fa-f]+\b")).alias("sap_values"),
        F.array_distinct(_all(text, r"(?i)\b(?:class|CL)\s*=?\s*(\d{1,3})\b", 1)).alias("class_ids"),
    )


def table_number(table_id: Column) -> Column:
    """The digits at the end of a table's id as a number; null without."""
    return F.nullif(F.regexp_extract(_v(table_id), r"(\d+)$", 1), F.lit("")).cast("long")


def clause_key(heading: Column) -> Column:
    """The first two numbers of a clause; null without a leading number."""
    number = F.regexp_extract(F.trim(_v(heading)), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.substring_index(number, ".", 2))


def outline_path(heading: Column) -> Column:
    """Annex letter, letter and numbers, or numbers of a heading; null without."""
    h = F.trim(_v(heading))
    annex, letter, under, plain = (F.regexp_extract(h, OUTLINE, i) for i in (1, 2, 3, 4))
    ints = lambda t: F.transform(F.split(t, "\\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.when(annex != "", F.array(F.upper(annex))).when(letter != "", F.concat(F.array(F.upper(letter)), ints(under))).when(plain != "", ints(plain))


def is_toc_line(line: Column) -> Column:
    return _v(line).rlike(TOC_END) | (F.size(_all(line, TOC_LEADER)) >= 3)


# --- identities


def stable_id(source_id: Column, kind: Column, requirement: Column) -> Column:
    return F.concat(F.lit("SREQ-"), F.upper(F.substring(F.sha2(F.concat_ws("\n", _v(source_id), _v(kind), match_term(requirement)), 256), 1, 16)))


def fingerprint_text(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(_v(value), r"[\x00-\x1f\x7f]", ""), r"\s+", " ")))


def content_fingerprint(submodule: Column, description: Column, section: Column, objective: Column, behaviors: Column, title: Column) -> Column:
    """SHA-1 of the normal forms of the first three fields, or of the last three where those are empty."""
    first, rest = [[fingerprint_text(c) for c in cs] for cs in ((submodule, description, section), (objective, behaviors, title))]
    return F.sha1(F.when(F.concat(*first) != "", F.concat_ws("\x1f", *first)).otherwise(F.concat_ws("\x1f", *rest)))


def narrative_fingerprint(objective: Column, behaviors: Column, description: Column, title: Column, requirement: Column, software: Column) -> Column:
    named = {"behaviors": behaviors, "description": description, "objective": objective, "requirement": requirement, "software_requirement_text": software, "title": title}
    body = F.struct(*(fingerprint_text(c).alias(k) for k, c in named.items()), F.lit("requirement-narrative-fp-v1").alias("v"))
    return F.sha1(F.to_json(body))


def structural_fingerprint(codes: Column, ownership: Column, module: Column, section: Column, block_ids: Column) -> Column:
    body = F.struct(
        fingerprint_text(module).alias("module"),
        F.array_sort(F.array_distinct(codes)).alias("obis"),
        fingerprint_text(ownership).alias("ownership"),
        F.array_sort(F.filter(block_ids, lambda x: x != "")).alias("source_block_ids"),
        fingerprint_text(section).alias("source_section"),
        F.lit("requirement-structural-fp-v1").alias("v"),
    )
    return F.sha1(F.to_json(body))


def candidate_hash(section_path: Column, heading: Column, text: Column, block_ids: Column) -> Column:
    """Hash of a clause candidate in its domain, over sorted keys."""
    none = _lits(())
    payload = F.struct(F.coalesce(block_ids, none).alias("block_ids"), _v(heading).alias("heading"), F.coalesce(section_path, none).alias("section_path"), _v(text).alias("text"))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(F.lit("clause-candidate-hash/v1").alias("domain"), payload.alias("payload"))), 256))


# --- fields of table rows


def field(fields: Column, header: str) -> Column:
    """The value under a header: equal in normal form, else equal without blanks; empty without."""
    entries, want = F.map_entries(fields), " ".join(header.strip().lower().replace("_", " ").replace("-", " ").split())
    same = F.filter(entries, lambda e: rules.header_part(e["key"]) == want)
    close = F.filter(entries, lambda e: F.replace(rules.header_part(e["key"]), F.lit(" "), F.lit("")) == want.replace(" ", ""))
    return scalars.clean(F.coalesce(F.get(same, F.lit(0))["value"], F.get(close, F.lit(0))["value"]))


def is_object_header(fields: Column) -> Column:
    return (field(fields, "Object/attribute name") != "") & (field(fields, "CL") != "")


def is_attribute_row(fields: Column) -> Column:
    return (field(fields, "#") != "") & (field(fields, "Object/attribute name") != "")


def is_non_matrix_row(fields: Column) -> Column:
    return F.arrays_overlap(F.transform(F.map_keys(fields), rules.header_part), _lits(NON_MATRIX_KEYS))


def valued_facts(fields: Column) -> Column:
    """(subject_header, subject, predicate_header, value) of every filled cell of a matrix row that is no marker, note or verdict."""
    entries = F.map_entries(fields)
    head, subject = F.get(entries, F.lit(0))["key"], scalars.clean(F.get(entries, F.lit(0))["value"])
    rest = F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(1)))
    use = lambda e: (scalars.clean(e["value"]) != "") & ~rules.is_marker(scalars.clean(e["value"])) & ~e["key"].rlike(NOTE_HEADER) & ~e["key"].rlike(DISPOSITION_HEADER)
    facts = F.transform(F.filter(rest, use), lambda e: F.struct(head.alias("subject_header"), subject.alias("subject"), e["key"].alias("predicate_header"), scalars.clean(e["value"]).alias("value")))
    ok = (F.size(entries) >= 3) & ~is_non_matrix_row(fields) & (subject != "") & ~subject.rlike(INDEX_VALUE)
    return F.when(ok, facts).otherwise(F.filter(facts, lambda _: F.lit(False)))


def marker_facts(headers: Column, row: Column, columns: Column) -> Column:
    """(subject, predicate_header, marker) of the marked cells of a row in the given columns (0-based); none under an empty or marked subject."""
    subject = scalars.clean(F.get(row, F.lit(0)))
    marked = F.filter(F.array_sort(columns), lambda i: (i < F.size(row)) & rules.is_marker(scalars.clean(F.get(row, i))))
    facts = F.transform(marked, lambda i: F.struct(subject.alias("subject"), F.coalesce(F.get(headers, i), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("predicate_header"), scalars.clean(F.get(row, i)).alias("marker")))
    return F.when((subject != "") & ~rules.is_marker(subject), facts).otherwise(F.filter(facts, lambda _: F.lit(False)))


def access_rights(text: Column) -> Column:
    """(client, code, read, write, allowed) of the four clients of a/b/c/d; missing parts are empty."""
    parts = F.transform(F.split(scalars.clean(text), "/"), lambda x: F.upper(F.trim(x)))
    code = lambda i: _v(F.get(parts, F.lit(i)))
    one = lambda i, name: F.struct(F.lit(name).alias("client"), code(i).alias("code"), F.contains(code(i), F.lit("R")).alias("read"), F.contains(code(i), F.lit("W")).alias("write"), (~code(i).isin("", "--")).alias("allowed"))
    cells = F.array(*(one(i, name) for i, name in enumerate(CLIENTS)))
    return F.when(scalars.clean(text) != "", cells).otherwise(F.filter(cells, lambda _: F.lit(False)))


def access_cells(access: Column) -> Column:
    return F.array(*(_v(F.element_at(access, x)) for x in CLIENTS))


def table_text(headers: Column, rows: Column, limit: int | None = None) -> Column:
    """Headers and rows with bars, rows at the headers' width, and how many were left out."""
    n = F.size(headers)
    shown = rows if limit is None else F.slice(rows, 1, limit)
    line = lambda r: F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), 1, n), " | ")
    lines = F.concat(F.array(F.array_join(headers, " | ")), F.transform(shown, line))
    if limit is not None:
        more = F.size(rows) - limit
        lines = F.concat(lines, F.when(more > 0, F.array(F.concat(F.lit("... "), more.cast("string"), F.lit(" more rows")))).otherwise(_lits(())))
    return F.array_join(lines, "\n")


def table_type(headers: Column, has_facts: Column) -> Column:
    low = F.transform(headers, lambda h: F.lower(h))
    has = lambda *xs: F.size(F.array_except(_lits(xs), low)) == 0
    return F.when(has_facts, "marker_matrix").when(has("object/attribute name", "cl", "value"), "inherited_context_table").when(has("event number") | has("number of event"), "enumeration_with_code").otherwise("row_table")


# --- verdicts on rows


def excluded_reason(text: Column, kind: Column, region: Column, noise: Column, rejected: Column) -> Column:
    """Why a block is no coverage candidate, the first reason that holds."""
    v = F.trim(_v(text))
    region = F.coalesce(F.nullif(region, F.lit("")), F.lit("body"))
    return (
        F.when(F.coalesce(rejected, F.lit(False)), "expert_non_requirement")
        .when(F.coalesce(noise, F.lit(False)), "noise")
        .when(region != "body", "non_body")
        .when(_v(kind) == "heading", "heading")
        .when(v == "", "empty")
        .when((F.length(v) <= 160) & v.rlike(rules.REFERENCE_LINE), "reference")
        .when(v.rlike(rules.HEADING_LINE), "heading")
        .otherwise("not_candidate")
    )


def base_disposition(text: Column, role: Column, leaf: Column, header: Column, commercial: Column, incomplete: Column, candidate: Column) -> Column:
    """(disposition, confidence, reason) of a table cell. candidate: ambiguous_structure, weak_signal, unsignaled_data, untyped_colon_spec or null."""
    normative = rules.is_normative(text)
    one = lambda a, b, c: F.struct(F.lit(a).alias("disposition"), F.lit(b).alias("confidence"), (c if isinstance(c, Column) else F.lit(c)).alias("reason"))
    v = F.trim(_v(text))
    return (
        F.when(commercial, one("excluded", "high", "tender_commercial_table"))
        .when(incomplete, one("review", "low", "parse_incomplete"))
        .when(v.rlike(NOT_APPLICABLE), one("excluded", "high", "explicit_not_applicable"))
        .when(candidate == "ambiguous_structure", one("review", "low", "ambiguous_structure_cell"))
        .when(candidate == "weak_signal", one("review", "medium", "weak_sentence_signal"))
        .when(candidate == "unsignaled_data", one("review", "medium", "unsignaled_data_cell"))
        .when(candidate == "untyped_colon_spec", one("review", "medium", "untyped_colon_spec"))
        .when(_v(header).rlike(INDEX_HEADER) & _v(text).rlike(INDEX_VALUE), one("excluded", "high", "index_column"))
        .when(normative & (leaf == "cell"), one("target", "high", "normative_text"))
        .when(normative & (leaf == "row"), one("composite", "high", "normative_text"))
        .when(normative, one("review", "medium", "normative_context_conflict"))
        .when(role.isin("title", "header", "row_header", "group_header"), one("context", "high", F.concat(F.lit("structural_role:"), role)))
        .when(leaf == "cell", one("composite", "high", "cell_leaf_owner"))
        .when(leaf == "row", one("composite", "high", "row_leaf_owner"))
        .otherwise(one("context", "high", F.concat(F.lit("leaf_kind:"), leaf)))
    )


def review_risk(kind: Column, confidence: Column, ambiguous: Column, mandatory: tuple[str, ...], high: tuple[str, ...], least: float = 0.75) -> Column:
    weak = F.coalesce(confidence, F.lit(0.0)) < least
    return F.when(kind.isin(*mandatory), "mandatory_review").when(kind.isin(*high) | weak | F.coalesce(ambiguous, F.lit(False)), "high_risk").otherwise("low_risk")


def stub_review(requirement_id: Column, kind: Column, confidence: Column, ambiguous: Column, mandatory: tuple[str, ...], high: tuple[str, ...]) -> Column:
    """The review that rules alone give: expert for risky rows, else accept."""
    risk = review_risk(kind, confidence, ambiguous, mandatory, high)
    expert = risk != "low_risk"
    return F.struct(
        F.concat(F.lit("REVIEW-"), requirement_id).alias("task_id"),
        risk.alias("risk"),
        F.when(expert, "needs_expert").otherwise("accept").alias("decision"),
        F.when(expert, 0.5).otherwise(0.8).alias("confidence"),
        F.concat(F.lit("Stub review routed to "), risk, F.lit(".")).alias("note"),
    )


def should_review(kind: Column, source: Column, confidence: Column, ambiguous: Column, types: tuple[str, ...], sources: tuple[str, ...], mode: str = "targeted", least: float = 0.75, source_least: float = 0.85) -> Column:
    """Whether a row goes to review: every row in mode all; else ambiguous, weak, listed, or weak for its listed source."""
    if mode == "all":
        return F.lit(True)
    if mode != "targeted":
        raise ValueError(f"unknown review mode: {mode}")
    sure = F.coalesce(confidence, F.lit(0.0))
    return F.coalesce(ambiguous, F.lit(False)) | (sure < least) | F.coalesce(kind.isin(*types), F.lit(False)) | (F.coalesce(source.isin(*sources), F.lit(False)) & (sure < source_least))


def final_outcome(hard_status: Column, vote: Column) -> Column:
    return (
        F.when(hard_status == "fail", "hard_veto")
        .when(vote.isNull(), "rules_only_suspect")
        .when(vote == "invalid_llm_code_drift", "llm_vote_invalid")
        .when(vote == "confirmed_issue", "llm_confirmed_issue")
        .when(vote == "not_an_issue", "llm_cleared")
        .otherwise("llm_uncertain")
    )


def labels(text: Column) -> Column:
    """Labels with a keyword in the text, in order; the protocol label without any."""
    low = F.lower(_v(text))
    found = F.array_compact(F.array(*(F.when(any_of(low, words), F.lit(name)) for name, words in LABELS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_LABEL)))


def object_name(matches: Column, text: Column) -> Column:
    """The name of the first match of a preferred type, else the first run of up to five capitalised words; empty for a stop word."""
    named = F.filter(matches, lambda m: m["type"].isin(*PREFERRED_TYPES) & (_v(m["name"]) != ""))
    found = F.trim(F.regexp_extract(scalars.clean(text), r"\b([A-Z][A-Za-z0-9_/-]*(?:\s+[A-Z][A-Za-z0-9_/-]*){0,4})\b", 1))
    return F.when(F.size(named) > 0, F.get(named, F.lit(0))["name"]).when(F.substring_index(found, " ", 1).isin(*OBJECT_STOPWORDS), "").otherwise(found)


def merged_tags(*lists: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*lists), lambda t: F.coalesce(t, F.lit("")) != ""))


def behavior_signal(text: Column, least: int = 2) -> Column:
    actions = rules.modal_actions(text)
    return F.struct((F.size(actions) >= least).alias("fired"), F.size(actions).alias("count"), actions.alias("actions"))


def condition_signal(text: Column, least: int = 1) -> Column:
    words = rules.connectors(text)
    return F.struct((F.size(words) >= least).alias("fired"), F.size(words).alias("count"), words.alias("connectors"))


def entry_matches(layer: Column, kind: Column, want_layer: str | None = None, want_kind: str | None = None, scope_kinds: tuple[str, ...] | None = None, scope_layers: tuple[str, ...] | None = None) -> Column:
    """Filters of a knowledge search; a filter that is not given lets all pass."""
    out = F.lit(True)
    for column, wanted in ((layer, (want_layer,) if want_layer else None), (kind, (want_kind,) if want_kind else None), (kind, scope_kinds), (layer, scope_layers)):
        if wanted is not None:
            out = out & F.coalesce(column.isin(*wanted), F.lit(False))
    return out


# --- verification columns


def implemented_state(text: Column) -> Column:
    t = F.trim(_v(text))
    known = F.lit("not_started")
    for label, state in IMPLEMENTED.items():
        known = F.when((t == label) | (F.lower(t) == label), state).otherwise(known)
    return F.when(t.isin("not_started", "in_progress", "done"), t).otherwise(known)


def confirmation(text: Column) -> Column:
    """(confirmed, by): words of denial are none, words of consent confirm, other text is who confirmed."""
    t = F.trim(_v(text))
    person = F.trim(F.regexp_extract(t, r"已确认[（(]\s*([^)）]*?)\s*[)）]", 1))
    stamped = F.regexp_extract(person, " ([^ ]*)$", 1).rlike(r"\d{4}|T\d|:\d{2}|^\d")
    by = F.when(t.rlike(r"已确认[（(]"), F.when(stamped, F.regexp_replace(person, " [^ ]*$", "")).otherwise(person)).when(t.isin("是", "已确认", "yes", "Y", "y", "True", "true", "1"), "").otherwise(t)
    none = (t == "") | t.isin("否", "未确认", "no", "N", "n", "False", "false")
    return F.struct((~none).alias("confirmed"), F.when(none, "").otherwise(by).alias("by"))


def verification(cells: Column) -> Column:
    """The six verification columns: three confirmations, state, test cases, done."""
    at = lambda i: _v(F.get(cells, F.lit(i)))
    return F.struct(
        confirmation(at(0)).alias("project_manager"),
        confirmation(at(1)).alias("test_lead"),
        confirmation(at(2)).alias("dev_test"),
        implemented_state(at(3)).alias("implemented"),
        F.filter(F.transform(F.split(F.trim(at(4)), "[;\n,、 ]+"), lambda x: F.trim(x)), lambda x: x != "").alias("test_case_ids"),
        F.trim(at(5)).isin(*DONE_WORDS).alias("test_completed"),
    )


# --- contracts of rows held as JSON


def row_problems(row: Column) -> Column:
    """Missing keys and wrong kinds of a requirement row in JSON, as key:problem, in the order of the contract."""
    kinds = F.transform(F.json_object_keys(row), lambda k: k)
    value = lambda k: F.get_json_object(row, f"$.{k}")
    present = lambda k: F.array_contains(kinds, k)
    is_list = lambda k: F.coalesce(value(k).rlike(r"^\["), F.lit(False))
    checks = [F.when(~present(k), F.lit(f"{k}:missing")) for k in REQUIRED_KEYS]
    checks += [F.when(present(k) & ~is_list(k), F.lit(f"{k}:not_a_list")) for k in LIST_KEYS]
    checks += [F.when(present(k) & (is_list(k) | F.coalesce(value(k).rlike(r"^\{"), F.lit(False)) | value(k).isNull() | ~row.rlike(rf'"{k}"\s*:\s*"')), F.lit(f"{k}:not_text")) for k in TEXT_KEYS]
    return F.array_compact(F.array(*checks))


def atomic_problems(req_id: Column, stable_id: Column, texts: dict[str, Column], refs: Column, confidence: Column) -> Column:
    """Fields of an atomic requirement that break its contract."""
    checks = [F.when(~req_id.rlike(r"^AREQ-[0-9]{6}$"), F.lit("req_id")), F.when(~stable_id.rlike(r"^SREQ-[0-9A-F]{16}$"), F.lit("stable_req_id"))]
    checks += [F.when(F.trim(c) == "", F.lit(k)) for k, c in texts.items()]
    checks += [F.when(F.exists(refs, lambda r: F.trim(_v(r)) == ""), F.lit("source_refs")), F.when(~confidence.between(0, 1), F.lit("confidence"))]
    return F.array_compact(F.array(*checks))
