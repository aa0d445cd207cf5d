"""Expressions of the function catalogue: what tells variants of one function from different functions.

Texts may be null, which counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions import scalars

# fixed values
ACTION_TERMS = (
    "collect", "record", "store", "transmit", "report", "detect", "monitor", "support", "configure", "archive", "provide", "define", "manage", "synchronize", "sync",
    "采集", "收集", "记录", "存储", "远程传输", "传输", "上报", "报告", "检测", "监测", "支持", "配置", "归档", "提供", "定义", "管理", "同步", "要求", "功能",
    "远传", "发送", "通知", "执行", "控制", "查询", "读取", "获取", "保留", "触发",
)
GENERIC_TERMS = (
    "the", "a", "an", "device", "meter", "system", "shall", "must", "should", "设备", "系统", "应", "必须", "须", "可", "相关", "数据对象", "及", "与", "和", "并", "将",
)
PROFILE = r"(?<![A-Za-z0-9])([A-Z]{1,4})[-_]?(\d{1,3})(?![A-Za-z0-9])"
PERIOD = r"(?i)(?<![A-Za-z0-9])(\d+(?:\.\d+)?)\s*-?\s*(分钟|分|小时|时|天|日|个月|月|秒|s|sec(?:ond)?s?|min(?:ute)?s?|h(?:our)?s?|days?|months?)"
MEASURE = r"(?i)(?<![A-Za-z0-9])(\d+(?:\.\d+)?)\s*(L/h|m3/h|m³/h|%|°C|℃|V|A|Hz|bar|kPa|Pa|mm|cm|kg|g)(?![A-Za-z])"
OBIS = r"\b\d+-\d+:[0-9.*xX]+(?:\.[0-9.*xX]+){1,4}\b"
CLASS_NUMBER = r"(?i)(?:interface\s+class|class\s*id|class_id|接口类)\s*[:=]?\s*(\d+)"
EVENT = r"(?i)([A-Za-z][A-Za-z\s-]{1,40}?\s+event|[一-鿿A-Za-z0-9_-]{1,20}事件)"
PERIOD_UNITS = {
    "分钟": "min", "分": "min", "min": "min", "minute": "min", "minutes": "min",
    "小时": "h", "时": "h", "h": "h", "hour": "h", "hours": "h",
    "天": "day", "日": "day", "day": "day", "days": "day",
    "个月": "month", "月": "month", "month": "month", "months": "month",
    "秒": "s", "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s",
}
LIFECYCLE_ROLES = (
    ("collect", ("采集", "收集", "获取采样", "collect", "acquire", "sample")),
    ("configure", ("配置", "设置", "定义", "configure", "set ", "define")),
    ("detect", ("检测", "监测", "触发", "detect", "monitor", "trigger")),
    ("execute", ("执行", "控制", "计算", "execute", "control", "calculate")),
    ("store", ("存储", "记录", "归档", "保留", "store", "record", "archive", "retain")),
    ("query", ("查询", "读取", "获取", "query", "read", "retrieve", "get ")),
    ("report", ("上报", "传输", "发送", "通知", "report", "transmit", "send", "notify")),
    ("access", ("权限", "访问", "授权", "access", "authorize")),
    ("recover", ("恢复", "重试", "回退", "recover", "retry", "fallback")),
)


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_v(text), F.lit(pattern), F.lit(group))


def without_terms(text: Column, terms: tuple[str, ...] = ACTION_TERMS + GENERIC_TERMS) -> Column:
    """Lower case without the terms, longest first: Latin ones as whole words, others wherever they stand."""
    out = F.lower(_v(text))
    for term in sorted(terms, key=len, reverse=True):
        latin = term.isascii() and term.isalpha()
        out = F.regexp_replace(out, rf"\b{term}\b", " ") if latin else F.replace(out, F.lit(term), F.lit(" "))
    return out


def event_subject(text: Column) -> Column:
    """The longest, then last, normal form of what an event phrase is about; empty without one."""
    keys = F.transform(_all(text, EVENT, 1), lambda x: scalars.key_of(without_terms(x)))
    scored = F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    return F.coalesce(F.array_max(scored)["k"], F.lit(""))


def variant_tokens(text: Column, title: Column) -> Column:
    """Profile names (prefix and number) of the title, then periods of the text, each once."""
    title = F.when(_v(title) == "", _v(text)).otherwise(title)
    profiles = F.zip_with(_all(title, PROFILE, 1), _all(title, PROFILE, 2), lambda a, b: F.concat(F.upper(a), b))
    periods = F.zip_with(_all(text, PERIOD, 1), _all(text, PERIOD, 2), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(profiles, periods))


def protected_tokens(text: Column, title: Column) -> Column:
    """Object codes, class numbers and variant tokens, each once."""
    return F.array_distinct(F.concat(_all(text, OBIS), F.transform(_all(text, CLASS_NUMBER, 1), lambda x: F.concat(F.lit("class "), x)), variant_tokens(text, title)))


def periods(text: Column) -> Column:
    """Distinct periods as value and unit of one spelling, sorted; units are not converted."""
    names = F.create_map(*[F.lit(x) for pair in PERIOD_UNITS.items() for x in pair])
    named = lambda a, b: F.concat_ws(" ", a, F.coalesce(F.get(F.map_values(F.map_filter(names, lambda k, _: k == F.lower(b))), F.lit(0)), F.lower(b)))
    return F.array_sort(F.array_distinct(F.zip_with(_all(text, PERIOD, 1), _all(text, PERIOD, 2), named)))


def periods_compatible(a: Column, b: Column) -> Column:
    """Texts without a period go with any, others with those of the same periods."""
    x, y = periods(a), periods(b)
    return (F.size(x) == 0) | (F.size(y) == 0) | (x == y)


def constraints_by_unit(text: Column) -> Column:
    """Distinct (unit, value) of periods and measures, sorted."""
    def found(pattern: str) -> Column:
        unit = lambda u: F.replace(F.replace(F.lower(u), F.lit("m³"), F.lit("m3")), F.lit("℃"), F.lit("°c"))
        return F.zip_with(_all(text, pattern, 2), _all(text, pattern, 1), lambda u, v: F.struct(unit(u).alias("unit"), v.alias("value")))

    return F.array_sort(F.array_distinct(F.concat(found(PERIOD), found(MEASURE))))


def proper_tokens(title: Column) -> Column:
    """Words with a capital inside, or in capitals, in lower case; sorted."""
    proper = lambda x: F.substring(x, 2, 10_000).rlike("[A-Z]") | (x.rlike("^[A-Z0-9]+$") & (F.length(x) >= 2))
    return F.array_sort(F.array_distinct(F.transform(F.filter(_all(title, "[A-Za-z][A-Za-z0-9]*"), proper), lambda x: F.lower(x))))


def variants_conflict(a: Column, b: Column) -> Column:
    """Whether two titles differ in their numbers or their proper words."""
    ints = lambda t: F.array_sort(F.array_distinct(_all(t, r"\d+")))
    return (ints(a) != ints(b)) | (proper_tokens(a) != proper_tokens(b))


def lifecycle_role(title: Column, description: Column) -> Column:
    """The role whose term stands first: in the title, else the first sentence, else the whole description."""
    def first(text: Column) -> Column:
        at = [F.struct(F.instr(text, F.lit(t)).alias("at"), F.lit(i).alias("i"), F.lit(role).alias("role")) for i, (role, terms) in enumerate(LIFECYCLE_ROLES) for t in terms]
        return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["role"]

    description = F.lower(_v(description))
    return F.coalesce(first(F.lower(_v(title))), first(F.get(F.split(description, "[。.!?；;]", 2), 0)), first(description), F.lit("behavior"))


def family(title: Column, text: Column, module: Column) -> Column:
    """(key, method): module and kind with the concept that is left when action words, profile numbers and periods are taken out."""
    title, text, module = _v(title), _v(text), scalars.key_of(module)
    named = F.when(title == "", text).otherwise(title)
    prefixes = F.array_distinct(F.transform(_all(named, PROFILE, 1), lambda x: F.upper(x)))
    one = F.when(F.size(prefixes) == 1, F.get(prefixes, 0)).otherwise("PROFILE")
    concept = lambda t: scalars.key_of(without_terms(t))
    profile = F.concat_ws(":", module, F.lit("profile"), one, concept(F.concat_ws("", F.regexp_replace(named, F.lit(PROFILE), F.concat(F.lit(" "), one, F.lit(" profile "))))))
    low = F.lower(text)
    recorded = F.size(_all(text, PERIOD)) > 0
    kept = F.lit(False)
    for t in ("archive", "归档", "曲线", "profile", "记录"):
        kept = kept | F.contains(low, F.lit(t))
    period = F.concat_ws(":", module, F.lit("period"), concept(F.regexp_replace(title, PERIOD, " period ")))
    subject = event_subject(named)
    plain = scalars.key_of(F.regexp_replace(F.regexp_replace(without_terms(title), PROFILE, " profile "), PERIOD, " period "))
    legacy = F.concat_ws(":", module, F.lit("concept"), F.when(plain != "", plain).otherwise(scalars.key_of(title)))
    pair = lambda key, method: F.struct(key.alias("key"), F.lit(method).alias("method"))
    return (
        F.when(F.size(prefixes) > 0, pair(profile, "protocol_profile_variant"))
        .when(recorded & kept, pair(period, "period_variant"))
        .when(subject != "", pair(F.concat_ws(":", module, F.lit("event"), subject), "event_subject"))
        .otherwise(pair(legacy, "legacy_concept"))
    )
