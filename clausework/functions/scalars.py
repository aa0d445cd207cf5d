"""Scalar expressions over strings, numbers and arrays: normal forms, codes, number guards, similarities and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
REPLACEMENTS = (
    ("\u00a0", " "),
    ("\u3000", " "),
    ("\uf020", " "),
    ("\uf03d", "="),
    ("\uf03e", ">"),
    ("\uf8e7", "-"),
    ("\u2018", "'"),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\u2013", "-"),
    ("\u2014", "-"),
    ("\u2212", "-"),
    ("\u2026", "..."),
)
CODES = (r"\d+-\d+:\d+(?:\.\d+)+", r"G[\d,\s]*-?SG[\w]+-E[\w]+", r"0x[0-9A-Fa-f]+")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ENUM_MARKER = r"(?m)(^[ \t]*|[\n\r.;；:：,，、。！？!?][ \t]*)(\d{1,2})\s*[.、)）](?!\d)"
REFERENCES = (
    r"\d+(?:\.\d+){2,}",
    r"[A-Z](?:\.\d+)+",
    r"(?i)(?<![A-Za-z])(?:subclause|clause|table|figure|annex|type|part|class|note|section|chapter)\s+\d{1,2}(?![0-9])",
)
STOPWORDS = ("the", "a", "an", "of", "for", "and", "to", "in", "on", "shall", "must", "should", "be", "is", "are", "with", "by", "or", "as", "at", "per", "when", "that", "this")
CJK_STOPWORDS = ("需求", "要求", "功能", "支持", "应", "必须", "可", "及", "与", "和", "或")
ASSOCIATIONS = ("RC", "PC", "SC", "LC")


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean(text: Column) -> Column:
    """Typographic characters to plain ones, runs of white space to one space, trimmed; null to the empty text."""
    one = [(a, b) for a, b in REPLACEMENTS if len(b) == 1]
    out = F.translate(_v(text), "".join(a for a, _ in one), "".join(b for _, b in one))
    for a, b in REPLACEMENTS:
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    """At most n characters; a cut text ends with three dots."""
    c = clean(text)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("...")))


def without_space(text: Column) -> Column:
    return F.lower(F.regexp_replace(_v(text), r"\s+", ""))


def key_of(text: Column) -> Column:
    """Lower-case ASCII letters, digits and CJK characters only."""
    return F.regexp_replace(F.lower(_v(text)), "[^0-9a-z一-鿿]+", "")


def header_set(headers: Column) -> Column:
    """Normal forms of headers and of their parts between slashes, sorted."""
    norm = lambda x: F.trim(F.regexp_replace(F.translate(F.lower(x), "_-", "  "), r"\s+", " "))
    parts = F.flatten(F.transform(headers, lambda h: F.concat(F.array(norm(h)), F.transform(F.split(h, "/"), norm))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def pattern_score(headers: Column, title: Column, required: tuple[str, ...], indicators: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """50 and a point a header if all required ones are there; 10 for each indicator and 5 for each title word found."""
    own = header_set(headers)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    need = F.size(F.array_intersect(own, lits(required))) == len(required)
    base = F.when(need, F.lit(50 + len(required))).otherwise(0) if required else F.lit(0)
    low = F.lower(_v(title))
    title_hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return base + 10 * F.size(F.array_intersect(own, lits(indicators))) + 5 * title_hits


def number_word(text: Column) -> Column:
    """An English number word up to twenty to digits; other texts trimmed."""
    t = F.trim(_v(text))
    at = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.lower(t))
    return F.when(at > 0, (at - 1).cast("string")).otherwise(t)


def without_enumerators(text: Column) -> Column:
    return F.regexp_replace(_v(text), ENUM_MARKER, "$1 ")


def without_references(text: Column) -> Column:
    out = _v(text)
    for p in REFERENCES:
        out = F.regexp_replace(out, p, " ")
    return out


def joined_digits(text: Column) -> Column:
    """Digit groups of thousands without their separator."""
    return F.regexp_replace(_v(text), r"(?<=\d)[\s,](?=\d{3}(?:\D|$))", "")


def codes(text: Column) -> Column:
    """Distinct protected codes, sorted."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(_v(text), F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in CODES]))
    return F.array_sort(F.array_distinct(found))


def drift(made: Column, source: Column) -> Column:
    """Codes and integers that the made text has and the source lacks, sorted."""
    ints = lambda c: F.regexp_extract_all(joined_digits(c), F.lit(r"\d+"), F.lit(0))
    from_source = F.concat(ints(without_enumerators(source)), F.regexp_extract_all(_v(source), F.lit(r"\d+"), F.lit(0)))
    return F.array_sort(F.concat(F.array_except(codes(made), codes(source)), F.array_except(ints(without_enumerators(made)), from_source)))


def numbers(text: Column) -> Column:
    """All numbers with repeats, comma as point, sorted as text."""
    return F.array_sort(F.transform(F.regexp_extract_all(_v(text), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of character n-grams of the letters and digits; texts under 2n characters must be equal."""
    bare = lambda c: F.regexp_replace(_v(c), r"(?U)[\W_]+", "")
    x, y = bare(a), bare(b)
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))
    same = ((x != "") & (x == y)).cast("double")
    return F.when((F.length(x) < 2 * n) | (F.length(y) < 2 * n), same).otherwise(F.size(F.array_intersect(grams(x), grams(y))) / F.size(F.array_union(grams(x), grams(y))))


def search_tokens(text: Column) -> Column:
    """Latin tokens of two characters or more but stop words, CJK runs and their bigrams; distinct."""
    low = F.lower(_v(text))
    latin = F.filter(F.regexp_extract_all(low, F.lit("[0-9a-z]+"), F.lit(0)), lambda x: (F.length(x) >= 2) & ~x.isin(*STOPWORDS))
    runs = F.filter(F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    # a stop word as a whole run is no token by itself, but its run and pairs are
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, runs, pairs))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens, 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def column_letter(i: Column) -> Column:
    """Spreadsheet letters of a column, for every long; "A" below 1."""
    # 14 letters hold every long; pmod and a whole division, as a quotient of doubles is not exact
    rest = lambda t: F.pmod(t["left"] - 1, F.lit(26))
    next_left = lambda t: F.call_function("div", t["left"] - 1 - rest(t), F.lit(26)).cast("long")
    step = lambda t, _: F.when(t["left"] > 0, F.struct(next_left(t).alias("left"), F.concat(F.chr((rest(t) + 65).cast("int")), t["out"]).alias("out"))).otherwise(t)
    start = F.struct(i.cast("long").alias("left"), F.lit("").alias("out"))
    letters = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda t: t["out"])
    return F.when(i.isNull(), F.lit(None)).when(i < 1, "A").otherwise(letters)


def a1(row: Column, column: Column) -> Column:
    return F.concat(column_letter(column), row.cast("string"))


def edge_id(*parts: Column) -> Column:
    return F.concat(F.lit("RTM-"), F.substring(F.sha1(F.concat_ws("\x1f", *[_v(p.cast("string")) for p in parts])), 1, 16))


def slug(text: Column) -> Column:
    out = F.substring(F.trim(F.regexp_replace(F.regexp_replace(_v(text), r'[\\/:*?"<>|]', " "), r"\s+", " ")), 1, 120)
    return F.when(out == "", "untitled").otherwise(out)


def access_map(text: Column) -> Column:
    """The four parts of a/b/c/d by association; an empty map for any other number of parts."""
    parts = F.transform(F.split(_v(text), "/"), lambda x: F.trim(x))
    names = F.array(*[F.lit(x) for x in ASSOCIATIONS])
    return F.when(F.size(parts) == len(ASSOCIATIONS), F.map_from_arrays(names, parts)).otherwise(F.create_map().cast("map<string,string>"))


def padded(row: Column, width: int) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.lit(width) - F.size(row), F.lit(0)).cast("int")))


def cell_text(value: Column, kind: str) -> Column:
    """A typed cell as text: TRUE or FALSE, days for midnights and ISO form for other times, whole numbers without a fraction; null is empty."""
    if kind == "boolean":
        out = F.when(value, "TRUE").otherwise("FALSE")
    elif kind.startswith("timestamp"):
        day = F.date_format(value, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
        second = F.date_format(value, "SSSSSS") == "000000"
        out = F.when(day, F.date_format(value, "yyyy-MM-dd")).when(second, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif kind in ("double", "float") or kind.startswith("decimal"):
        out = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    else:
        out = value.cast("string")
    return F.when(value.isNull(), "").otherwise(out)


def float_or(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))
