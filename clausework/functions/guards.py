"""Guards on extracted rows: what a produced text may claim beside its source, each a column expression.

Texts may be null, which counts as empty. Sets come out as sorted arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import scalars
from clausework.functions.text import any_of

# fixed values
VAGUE = (
    "符合要求", "满足要求", "正常工作", "工作正常", "运行正常", "表现良好", "适当", "合理", "正确处理", "妥善处理", "gracefully", "properly",
    "reasonable", "as expected", "correctly", "appropriately", "满足标准", "符合规定", "符合标准", "无异常", "正确运行", "保持正常",
    "功能完好", "无误", "按规定", "满足本标准", "as specified", "as required", "functions normally", "works as intended", "without issue",
)
TESTABLE = r"[0-9０-９]|≥|≤|>|<|＝|=|不超过|不少于|不小于|不大于|之内|以内|以上|以下"
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
VALUE_UNIT = r"(?<![A-Za-z0-9])(\d+(?:[.,]\d+)?)\s*(l/h|m3/h|m³/h|mbar|bar|kPa|Pa|MHz|kHz|Hz|mm|cm|kg|g|ms|min|%|°C|℃|V|mA|A|mT|h|s)(?![A-Za-z])"
CN_REFERENCE = r"(?:表|图|条款|章节|附录|第)\s*[0-9A-Z]+(?:\.\d+)*\s*(?:节|章|条)?"
DESIGNATOR = r"\b[A-Za-z]{2,}-?\d{2,}\b"
STANDARD_REFERENCE = r"(?i)\b(?:EN|IEC|ISO|CEN|CENELEC|IEEE|ITU|NBR|ABNT|WELMEC|OIML)(?:\s?ISO)?\s?\d{2,6}(?:-\d{1,3})*\b"
WEAK_MODAL = r"(?i)\bshould\b|\brecommended\b|\bmay\b(?!\s+not\b)"
STRONG_MODAL = r"(?i)\bshall\b|\bmust\b|\brequired\b"
PRODUCED_STRONG = "必须|严禁|不得|禁止"
SOFTER = (("必须", "宜"), ("严禁", "不宜"), ("不得", "不宜"), ("禁止", "不宜"))
TERMS_SECTION = r"(?i)terms?\b|definitions?\b|abbreviat|术语|定义"
CONSTRAINT_MARK = r"(?i)\bshall\b|\bmust\b|\bshould\b|\bonly\b|\bat least\b|\bnot exceed\b|\bvalid for\b|\balways\b|必须|不得|只能|仅限|至少|不超过|应当|须"
CONSTRAINT_VALUE = r"(?i)(?:[≤≥<>±=]|max\w*|min\w*|最大|最小|上限|下限)\s*[0-9０-９]"
CITATION_ONLY = r"^[\s]*(?:pr)?(?:EN|ISO|IEC|OIML|NBR|ABNT)[\s\d:.,/()\-+A-Z]*$"
SCOPE_STATEMENT = r"(?i)^\s*this\s+(?:european\s+|international\s+)?standard\s+(?:specifies|applies|is\s+applicable|covers|defines)"
COMPLIANCE_PHRASE = (
    r"(?i)\b(?:valid\s+(?:type\s+)?certificate|certificate\s+(?:according|required|of)|declaration\s+of\s+conformity|legal\s+requirements?"
    r"|metrological\s+legislation|national\s+(?:metrological\s+)?legislation|verification\s+period|decree\s+(?:no\.?\s*)?\d[0-9A-Z./-]*(?:\s+Coll\.)?"
    r"|act\s+\d+[/-]\d+|laws?\s+in\s+force|governed\s+by\s+the\s+laws?|standards?,\s*regulations?\s+and\s+requirements?)\b"
)
COMPLY_WITH_LAW = r"(?i)\b(?:shall|must|is\s+required\s+to)\s+(?:meet\s+the\s+legal\s+requirements|comply\s+with\b.{0,100}\b(?:metrological\s+legislation|laws?\s+in\s+force))\b"
NUMBERED_APPROVAL = r"(?i)\bapprov(?:ed|al)\s+according\s+to\s+(?:STN\s+EN|EN|IEC|ISO|OIML)\s+(?:No\.\s*)?(?:\(EU\)\s*)?\d"
TECHNICAL_ACTION = (
    r"(?i)\b(?:shall|must|is\s+required\s+to)\b[^.!?;\n]{0,140}\b(?:measure(?:s|d|ment)?|record(?:s|ed|ing)?|store(?:s|d|ing)?|display(?:s|ed|ing)?"
    r"|communicat(?:e|es|ed|ing|ion)|support(?:s|ed|ing)?|withstand(?:s|ing)?|show\s+resistance|resist(?:s|ed|ance|ant)?|detect(?:s|ed|ing)?"
    r"|calculat(?:e|es|ed|ing|ion)|control(?:s|led|ling)?|disconnect(?:s|ed|ing)?|transmit(?:s|ted|ting)?|receiv(?:e|es|ed|ing)|log(?:s|ged|ging)?"
    r"|monitor(?:s|ed|ing)?|perform(?:s|ed|ing)?\s+tests?)\b"
)
TECHNICAL_SUBJECT = (
    r"(?i)\b(?:electricity\s+meter|meter|device|type\s+plate|nameplate|display|enclosure|terminal(?:\s+cover)?|modem)\b[^.!?;\n]{0,120}"
    r"\b(?:shall|must|is\s+required\s+to)\b[^.!?;\n]{0,80}\b(?:locat(?:e|es|ed|ing|ion)|contain(?:s|ed|ing)?)\b"
)
LEFT_BEHIND_LEAST, LEFT_BEHIND_WINDOW = 4, 800


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_v(text), F.lit(pattern), F.lit(group))


def vague_items(items: Column) -> Column:
    """Items that promise only in general terms and hold nothing to test, cut to 80 characters."""
    vague = lambda x: any_of(F.lower(x), VAGUE) & ~x.rlike(TESTABLE) & (F.size(scalars.codes(x)) == 0)
    return F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), vague), lambda x: F.substring(x, 1, 80))


def produced_ints(text: Column) -> Column:
    """Distinct integers, with groups of thousands joined."""
    return F.array_sort(F.array_distinct(_all(scalars.joined_digits(text), r"\d+")))


def source_ints(text: Column) -> Column:
    """Integers as they stand, with groups joined, and of number words and ordinals up to twenty and tenth."""
    words = F.array(*map(F.lit, CARDINALS)), F.array(*map(F.lit, ORDINALS))
    spelled = F.transform(
        _all(F.lower(_v(text)), rf"\b(?:{'|'.join(sorted(CARDINALS + ORDINALS, key=len, reverse=True))})\b"),
        lambda x: F.coalesce(F.nullif(F.array_position(words[0], x), F.lit(0)) - 1, F.array_position(words[1], x)).cast("string"),
    )
    return F.array_sort(F.array_distinct(F.concat(_all(text, r"\d+"), _all(scalars.joined_digits(text), r"\d+"), spelled)))


def unit_values(text: Column) -> Column:
    """Distinct (unit in lower case, value with a point), sorted."""
    pairs = F.arrays_zip(_all(text, VALUE_UNIT, 2).alias("u"), _all(text, VALUE_UNIT, 1).alias("v"))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.lower(p["u"]).alias("unit"), F.replace(p["v"], F.lit(","), F.lit(".")).alias("value")))))


def several_values(text: Column) -> Column:
    """Units with two or more different values, sorted."""
    units = F.transform(unit_values(text), lambda p: p["unit"])
    return F.array_sort(F.array_distinct(F.filter(units, lambda u: F.size(F.filter(units, lambda x: x == u)) >= 2)))


def pairing_risk(produced: Column, source: Column, has_table: Column) -> Column:
    """Units of several values on both sides, where no table pairs values with conditions."""
    return F.when(has_table, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_intersect(several_values(produced), several_values(source))))


def without_produced_references(text: Column) -> Column:
    out = scalars.without_references(text)
    for p in (STANDARD_REFERENCE, CN_REFERENCE, DESIGNATOR):
        out = F.regexp_replace(out, p, " ")
    return out


def foreign_standards(produced: Column, source: Column) -> Column:
    """Standard references of the produced text whose number the source does not name, the first of each number, in order."""
    refs = _all(produced, STANDARD_REFERENCE)
    root = lambda x: F.regexp_extract(x, r"\d{2,6}", 0)
    roots, known = F.transform(refs, root), F.transform(_all(source, STANDARD_REFERENCE), root)
    return F.filter(refs, lambda x, i: (root(x) != "") & ~F.array_contains(known, root(x)) & (F.array_position(roots, root(x)) == i + 1))


def values_left_behind(quote: Column, source: Column, captured: Column) -> Column:
    """Numbers near the quote that the row did not take along: their count from four on, else 0."""
    at = F.instr(_v(source), _v(quote))
    window = F.substr(_v(source), at, F.greatest(F.length(_v(quote)), F.lit(LEFT_BEHIND_WINDOW)))
    window = scalars.joined_digits(scalars.without_references(scalars.without_enumerators(window)))
    left = F.size(F.array_except(F.array_distinct(_all(window, r"\d+")), produced_ints(captured)))
    return F.when((_v(quote) != "") & (at > 0) & (left >= LEFT_BEHIND_LEAST), left).otherwise(0)


def modal_inflation(quote: Column, produced: Column, baseline: Column | None = None) -> Column:
    """Whether a quote that only recommends came out as an obligation."""
    base = _v(quote if baseline is None else baseline)
    return _v(quote).rlike(WEAK_MODAL) & ~_v(quote).rlike(STRONG_MODAL) & ~base.rlike(STRONG_MODAL) & _v(produced).rlike(PRODUCED_STRONG)


def softened(text: Column) -> Column:
    out = _v(text)
    for hard, soft in SOFTER:
        out = F.replace(out, F.lit(hard), F.lit(soft))
    return out


def row_key(quote: Column, title: Column, description: Column) -> Column:
    """The quote in lower case with single blanks, else the title, else the first 80 characters of the description."""
    one = F.lower(F.trim(F.regexp_replace(_v(quote), r"\s+", " ")))
    title = F.lower(F.trim(_v(title)))
    return F.when(one != "", one).when(title != "", title).otherwise(F.substring(F.lower(F.trim(_v(description))), 1, 80))


def is_definition_stub(context: Column, produced: Column, has_table: Column) -> Column:
    """A row of a terms section without an obligation, a value with a unit or a compared number."""
    bare = ~_v(produced).rlike(CONSTRAINT_MARK) & (F.size(unit_values(produced)) == 0) & ~_v(produced).rlike(CONSTRAINT_VALUE)
    return _v(context).rlike(TERMS_SECTION) & ~has_table & bare


def is_reference_stub(quote: Column, description: Column) -> Column:
    """A quote that only cites, or a text that only states a standard's scope."""
    quote = F.trim(_v(quote))
    return ((quote != "") & quote.rlike(CITATION_ONLY)) | F.when(quote != "", quote).otherwise(_v(description)).rlike(SCOPE_STATEMENT)


def has_compliance_signal(text: Column) -> Column:
    v = _v(text)
    return v.rlike(COMPLIANCE_PHRASE) | v.rlike(COMPLY_WITH_LAW) | v.rlike(NUMBERED_APPROVAL)


def is_compliance(text: Column) -> Column:
    v = _v(text)
    return has_compliance_signal(v) & ~v.rlike(TECHNICAL_ACTION) & ~v.rlike(TECHNICAL_SUBJECT)


def obligations(texts: Column, labels: Column) -> Column:
    """Trimmed texts with labels of at most 20 characters, without empty texts."""
    pairs = F.transform(F.arrays_zip(texts.alias("t"), labels.alias("l")), lambda p: F.struct(F.trim(_v(p["t"])).alias("text"), F.substring(F.trim(_v(p["l"])), 1, 20).alias("label")))
    return F.filter(pairs, lambda p: p["text"] != "")
