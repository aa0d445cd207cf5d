"""Table structure from cells: titles, headers, kinds, leaf plans and cell items, as relations over (table, row, column).

cells: by..., r, c (1-based), text, with a row for every cell, empty ones too. ranges: by..., r1, c1, r2, c2, closed merged ranges.
Row and column facts are grouped aggregates, so that a table of any height is dealt over many tasks; only the first three rows
below the titles are held as arrays. Every merged range counts through its first cell, the others are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records, rules, sentences

# fixed values
DEFINITION_HEADER = r"(?i)^(term|definition|术语|定义|abbreviation|缩略语)"
REQUIREMENT_HEADER = (
    r"(?i)requirement|technical|characteristic|value|spec(?:ification)?|min(?:imum)?|max(?:imum)?|limit|rating|nominal|tolerance|range|unit"
    r"|要求|指标|参数值|参数|规格|额定|限值|最小|最大|公差|单位|范围|值"
)
TERMS_SECTION = r"(?i)terms|definitions|abbreviations|术语|定义|缩略语|bibliography|参考文献"
SYNTHETIC_HEADER, NUMERIC = r"^column_\d+$", r"^[\d.,/\-\s]+$"
LETTERED = r"^\s*\(([a-zA-Z])\)\s*(.*)$"
DOTTED = r"^\s*(\d+(?:\.\d+)+)[.)]?\s*$"
OPERATION = r"(?i)^\s*[\"']?(?:GET|SET|ACTION|READ|WRITE|NOTIFY|PUSH|PULL|CREATE|DELETE|EXECUTE)[\"']?\s*$"
AXIS_MEMBER = r"(?i)^\s*(?:mode|attr(?:ibute)?|channel|profile|suite|level|role|class|interface|protocol|version|key)\s*(?:[/#:._-]\s*)?(?:[A-Z]|\d+|[A-Za-z]+\d+)\s*$"
QUALIFIED_OPERATION = r"(?i)^\s*(?:xDLMS\s+service|(?:xDLMS\s+)?service\s*[/#:._-]\s*[\"']?(?:GET|SET|ACTION|READ|WRITE)[\"']?)\s*$"
DIMENSION_LENGTH, MARKER_RATIO, PROSE_LENGTH, IDENTITY_LENGTH = 24, 0.30, 40, 120


def clean_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _dealt(df: DataFrame) -> DataFrame:
    """The side of a join that is dealt by its keys: the planner sizes exploded or packed rows by their small files and would broadcast millions."""
    return df.hint("merge")


# --- merged ranges


def normal_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that are not turned round, each once."""
    return ranges.where("r2 >= r1 and c2 >= c1").distinct()


def covered(ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c and the range (r1, c1, r2, c2) of every coordinate in a range; of several the first in order."""
    cells = normal_ranges(ranges).withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2")))
    return cells.groupBy(*by, "r", "c").agg(F.min(F.struct("r1", "c1", "r2", "c2")).alias("m"), F.count("*").alias("times")).select(*by, "r", "c", "m.*", "times")


def contradictory(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Tables with two different ranges that share a coordinate."""
    return covered(ranges, by).where("times > 1").select(*by).distinct()


def range_conflicts(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges with whether a cell that they cover holds a text of its own, other than the first cell's."""
    at = normal_ranges(ranges).withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2")))
    seen = at.join(_dealt(cells.select(*by, "r", "c", clean_cell(F.col("text")).alias("x"))), [*by, "r", "c"], "left")
    # the first cell is one of those that the range covers, so one join brings all of its texts
    first = (F.col("r") == F.col("r1")) & (F.col("c") == F.col("c1"))
    other = F.when(~first & (F.col("x") != ""), F.col("x"))
    g = seen.groupBy(*by, "r1", "c1", "r2", "c2").agg(F.coalesce(F.max(F.when(first, F.col("x"))), F.lit("")).alias("anchor"), F.min(other).alias("lo"), F.max(other).alias("hi"))
    return g.select(*by, "r1", "c1", "r2", "c2", F.coalesce((F.col("lo") != F.col("anchor")) | (F.col("hi") != F.col("anchor")), F.lit(False)).alias("conflict"))


# --- rows


def facts(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, text (cleaned) and what each cell says: signal, marker, technical, metadata, untyped, normative."""
    d = cells.select(*by, "r", "c", clean_cell(F.col("text")).alias("text")).withColumn("signal", rules.obligation_signal(F.col("text")))
    spec = F.col("signal") == "colon_spec"
    d = d.withColumns({"marker": rules.is_marker(F.col("text")), "technical": spec & rules.is_technical_spec(F.col("text")), "metadata": spec & rules.is_metadata_spec(F.col("text"))})
    return d.withColumns({"untyped": spec & ~F.col("technical") & ~F.col("metadata"), "strong": F.col("signal").isin("modal", "pattern")}).withColumn("normative", F.col("strong") | F.col("technical"))


def rows_of(found: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, r, width, height and per row: filled cells, whether they are alike, their signals, and whether a range spans the whole width."""
    filled = F.col("text") != ""
    some = lambda c: F.coalesce(F.bool_or(F.col(c) & filled), F.lit(False)).alias(c)
    rows = found.groupBy(*by, "r").agg(
        F.count_if(filled).alias("n"),
        (F.min(F.when(filled, F.col("text"))) == F.max(F.when(filled, F.col("text")))).alias("alike"),
        F.min_by(F.when(filled, F.col("text")), F.when(filled, F.col("c"))).alias("first"),
        some("normative"),
        some("strong"),
        F.coalesce(F.bool_or((F.col("signal") == "sentence_shape") & filled), F.lit(False)).alias("weak"),
    )
    size = found.groupBy(*by).agg(F.max("c").alias("width"), F.max("r").alias("height"))
    full = normal_ranges(ranges).where("c1 = 1").groupBy(*by, F.col("r1").alias("r")).agg(F.max("c2").alias("reach"))
    out = rows.join(_dealt(size), by).join(_dealt(full), [*by, "r"], "left")
    out = out.withColumn("full", F.coalesce(F.col("reach") >= F.col("width"), F.lit(False))).drop("reach")
    return out.withColumn("group_header", F.col("full") & F.coalesce("alike", F.lit(False)) & ~rules.is_normative(F.col("first")))


def title_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `title`: leading rows of one text merged over the whole width."""
    so_far = Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("title", F.min((F.col("full") & F.coalesce("alike", F.lit(False))).cast("int")).over(so_far) == 1)


def _header_of(b1: Column, b2: Column, b3: Column, width: Column, explicit: Column) -> Column:
    """(rows, status, evidence) from the first three rows below the titles."""
    ints = lambda *xs: F.array(*xs).cast("array<int>")
    one = lambda rows, status, *evidence: F.struct(rows.alias("rows"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), F.array(*(e if isinstance(e, Column) else F.lit(e) for e in evidence)).alias("evidence"))
    texts = lambda b: F.coalesce(b["texts"], F.array().cast("array<string>"))
    letter = lambda x: F.lower(F.regexp_extract(x, LETTERED, 1))
    found = F.filter(F.transform(texts(b1), lambda x, i: F.struct(i.alias("i"), letter(x).alias("l"), F.trim(F.regexp_extract(x, LETTERED, 2)).alias("label"))), lambda m: m["l"] != "")
    n, first_i = F.size(found), F.get(found, F.lit(0))["i"]
    run = (n >= 3) & ~F.exists(F.transform(found, lambda m, j: (m["i"] != first_i + j) | (F.ascii(m["l"]) != 97 + j)), lambda bad: bad)
    labelled = F.size(F.filter(found, lambda m: m["label"] != ""))
    named = F.size(F.filter(found, lambda m: F.coalesce(F.get(texts(b2), m["i"]), F.lit("")) != ""))
    has2 = b2["r"].isNotNull()
    inline = run & (labelled == n) & has2 & ~b1["normative"]
    stacked = run & (labelled == 0) & has2 & ~F.coalesce(b2["normative"], F.lit(False)) & (named >= 3)
    letters = F.array_join(F.transform(found, lambda m: m["l"]), ",")
    dotted = lambda b: F.split(F.regexp_extract(F.coalesce(F.get(texts(b), F.lit(0)), F.lit("")), DOTTED, 1), "\\.")
    d1, d2 = dotted(b1), dotted(b2)
    up = lambda d: F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(1)))
    last = lambda d: F.get(d, F.size(d) - 1).try_cast("long")
    second = lambda b: F.coalesce(F.get(texts(b), F.lit(1)), F.lit(""))
    sequential = has2 & (second(b1) != "") & (second(b2) != "") & (F.size(d1) >= 2) & (F.size(d1) == F.size(d2)) & (F.transform(up(d1), lambda x: x.try_cast("long")) == F.transform(up(d2), lambda x: x.try_cast("long"))) & (last(d2) == last(d1) + 1)
    second_normative = F.coalesce(b2["normative"], F.lit(False))
    single = (width >= 2) & has2 & ~second_normative & (b1["n"] == 1) & ~rules.obligation_signal(b1["first"]).isin("modal", "pattern")
    parts = F.filter(F.transform(texts(b1), rules.header_part), lambda x: x != "")
    part0 = lambda b: rules.header_part(F.coalesce(F.get(texts(b), F.lit(0)), F.lit("")))
    rest = lambda b: F.slice(texts(b), 2, F.greatest(F.size(texts(b)) - 1, F.lit(1)))

    def continues(b: Column) -> Column:
        same = (part0(b1) != "") & (part0(b) == part0(b1))
        under = (part0(b) == "") & F.exists(rest(b), lambda x: x != "")
        return b["r"].isNotNull() & (F.size(parts) != F.size(F.array_distinct(parts))) & ~F.exists(texts(b), rules.is_marker) & (same | under)

    two = continues(b2)
    rows = F.when(two & continues(b3), ints(b1["r"], b2["r"], b3["r"])).when(two, ints(b1["r"], b2["r"])).otherwise(ints(b1["r"]))
    status = F.when(b1["normative"] & b1["strong"], "ambiguous").when(~b1["normative"] & b1["weak"], "ambiguous").otherwise("inferred")
    why = F.when(b1["normative"] & b1["strong"], "first_row_normative:ambiguous").when(b1["normative"], "first_row_label_spec:header").when(b1["weak"], "first_row_sentence_shape:ambiguous")
    evidence = F.array_compact(F.array(F.lit("first_row_header:default"), why, F.when(two, F.concat(F.lit("continuation_header:R"), b2["r"])), F.when(two & continues(b3), F.concat(F.lit("continuation_header:R"), b3["r"]))))
    told = F.array_join(F.transform(explicit, lambda x: x.cast("string")), ",")
    return (
        F.when(b1["r"].isNull(), one(ints(), "inferred", "no_body_rows"))
        .when(explicit.isNotNull(), one(explicit, "explicit", F.concat(F.lit("explicit_header_rows:"), F.when(told == "", "headerless").otherwise(told))))
        .when(inline, one(ints(b1["r"]), "explicit", F.concat(F.lit("lettered_composite_header:inline:"), letters), "letter_prefixes_a_to_j:hidden_from_display"))
        .when(stacked, one(ints(b1["r"], b2["r"]), "explicit", F.concat(F.lit("lettered_composite_header:stacked:"), letters), "letter_prefixes_a_to_j:hidden_from_display"))
        .when(sequential, one(ints(), "inferred", "sequential_clause_rows:headerless"))
        .when(b1["normative"] & ~has2, one(ints(), "ambiguous", "first_two_rows_normative:headerless", "single_normative_row:ambiguous"))
        .when(b1["normative"] & second_normative, one(ints(), "inferred", "first_two_rows_normative:headerless"))
        .when(single, one(ints(b1["r"], b2["r"]), "inferred", "first_row_single_cell:ambiguous", F.concat(F.lit("header_after_single_cell:R"), b2["r"])))
        .otherwise(F.struct(rows.alias("rows"), status.alias("status"), evidence.alias("evidence")))
    )


def structure(found: DataFrame, rows: DataFrame, by: list[str], explicit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tables, rows): by, width, height, header_rows, status, evidence; and the rows with role title, header or data and `ambiguous`.

    explicit: by, header_rows (array) of tables whose headers are known; an empty array is a table without.
    """
    titled = title_rows(rows, by)
    body = titled.where("not title").withColumn("b", F.row_number().over(Window.partitionBy(*by).orderBy("r"))).where("b <= 3")
    line = found.select(*by, "r", "c", "text").join(_dealt(body.select(*by, "r", "b")), [*by, "r"]).groupBy(*by, "r", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("texts"))
    line = line.join(_dealt(body.select(*by, "r", "n", "first", "normative", "strong", "weak")), [*by, "r"])
    at = lambda i: F.max(F.when(F.col("b") == i, F.struct("r", "texts", "n", "first", "normative", "strong", "weak"))).alias(f"b{i}")
    heads = titled.groupBy(*by).agg(F.max("width").alias("width"), F.max("height").alias("height")).join(_dealt(line.groupBy(*by).agg(at(1), at(2), at(3))), by, "left")
    if explicit is None:
        heads = heads.withColumn("told", F.lit(None).cast("array<int>"))
    else:
        heads = heads.join(_dealt(explicit.select(*by, F.col("header_rows").cast("array<int>").alias("told"))), by, "left")
    heads = heads.withColumn("h", _header_of(F.col("b1"), F.col("b2"), F.col("b3"), F.col("width"), F.col("told")))
    heads = heads.select(*by, "width", "height", "h.rows", "h.status", "h.evidence", "told")
    out = titled.drop("width", "height").join(_dealt(heads), by)
    header = F.array_contains("rows", F.col("r")) & ~F.col("title")
    out = out.withColumn("role", F.when(F.col("title"), "title").when(header, "header").otherwise("data"))
    alone = (F.col("role") != "data") & ~F.coalesce(F.array_contains("told", F.col("r")), F.lit(False)) & ~F.col("full") & (F.col("n") == 1)
    alone = alone & ~rules.obligation_signal(F.col("first")).isin("modal", "pattern") & ((F.col("width") >= 2) | (F.col("height") == 1))
    out = out.withColumn("ambiguous", alone)
    lone = out.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("ambiguous"), F.col("r")))).alias("lone"), F.count_if(F.col("role") == "data").alias("data_rows"), F.count_if(F.col("role") == "title").alias("titles"))
    tables = heads.drop("told").join(_dealt(lone), by)
    weak = (F.size("lone") > 0) & (F.col("status") == "inferred")
    more = F.concat(F.lit("single_cell_structure:ambiguous:R"), F.array_join(F.transform("lone", lambda x: x.cast("string")), ","))
    tables = tables.withColumn("evidence", F.when(weak, F.concat("evidence", F.array(more))).otherwise(F.col("evidence"))).withColumn("status", F.when(weak, "ambiguous").otherwise(F.col("status")))
    return tables.withColumnRenamed("rows", "header_rows"), out.drop("rows", "status", "evidence", "told")


# --- columns and kinds


def headers(found: DataFrame, rows: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """by, c, header: the different parts of a column's header rows, column_N without any, numbered where they repeat."""
    part = F.when(F.col("text").rlike(LETTERED), F.trim(F.regexp_extract("text", LETTERED, 2))).otherwise(F.col("text"))
    cells = found.join(_dealt(rows.where("role = 'header'").select(*by, "r")), [*by, "r"]).select(*by, "r", "c", part.alias("x"))
    parts = cells.groupBy(*by, "c").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("ps"))
    keys = F.transform("ps", lambda p: rules.header_part(p["x"]))
    own = F.filter("ps", lambda p, i: (rules.header_part(p["x"]) != "") & (F.array_position(keys, rules.header_part(p["x"])) == i + 1))
    parts = parts.select(*by, "c", F.array_join(F.transform(own, lambda p: p["x"]), " ").alias("x"))
    every = tables.select(*by, F.explode(F.sequence(F.lit(1), F.col("width"))).alias("c")).join(_dealt(parts), [*by, "c"], "left")
    base = F.coalesce(F.nullif(F.col("x"), F.lit("")), F.concat(F.lit("column_"), F.col("c").cast("string")))
    every = every.select(*by, "c", base.alias("base")).withColumn("i", F.row_number().over(Window.partitionBy(*by, "base").orderBy("c")))
    return every.select(*by, "c", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("i").cast("string"))).alias("header"))


def dimension_tag(header: Column) -> Column:
    """operation, axis_member or qualified_operation for headers that name a dimension; else null."""
    h = clean_cell(header)
    barred = (h == "") | h.rlike(SYNTHETIC_HEADER) | h.rlike(records.NOTE_HEADER) | rules.is_marker(h) | h.rlike(records.DISPOSITION_HEADER) | h.rlike(NUMERIC)
    return F.when(barred, None).when(h.rlike(OPERATION), "operation").when(h.rlike(AXIS_MEMBER), "axis_member").when(h.rlike(QUALIFIED_OPERATION), "qualified_operation")


def fact_columns(found: DataFrame, rows: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """by, c, tag: columns after the first, mostly markers, under a header that names a dimension."""
    data = found.where("c > 1 and text <> ''").join(_dealt(rows.where("role = 'data'").select(*by, "r")), [*by, "r"])
    most = data.groupBy(*by, "c").agg(F.count_if("marker").alias("m"), F.count("*").alias("n")).where("m > 0 and 2 * m >= n")
    return most.join(_dealt(heads), [*by, "c"]).select(*by, "c", dimension_tag(F.col("header")).alias("tag")).where("tag is not null")


def kinds(found: DataFrame, rows: DataFrame, heads: DataFrame, dims: DataFrame, by: list[str], leaf_section: DataFrame | None = None) -> DataFrame:
    """by, kind: mapping_matrix, prose_grid, parameter or other. leaf_section: by, section (the last part of the section path)."""
    some = lambda p: F.bool_or(F.col("header").rlike(p))
    named = heads.groupBy(*by).agg(F.count("*").alias("width"), F.bool_and(F.col("header").rlike(SYNTHETIC_HEADER)).alias("synthetic"), some(DEFINITION_HEADER).alias("defining"), some(REQUIREMENT_HEADER).alias("requiring"))
    data = found.join(_dealt(rows.where("role = 'data'").select(*by, "r")), [*by, "r"])
    full, first, later = F.col("text") != "", F.col("c") == 1, F.col("c") > 1
    median = lambda cond: F.median(F.when(cond, F.length("text")))
    body = data.groupBy(*by).agg(
        F.count_if(full & first).alias("firsts"),
        median(full & first).alias("first_length"),
        F.bool_and(F.when(full & first, F.col("text").rlike(NUMERIC))).alias("numbered"),
        F.count_if(full & later).alias("bodies"),
        F.count_if(full & later & F.col("marker")).alias("markers"),
        F.count_if(full).alias("filled"),
        median(full).alias("length"),
    )
    duties = data.where("normative and text <> ''").groupBy(*by, "c").agg(F.lit(1).alias("x")).groupBy(*by).agg(F.count("*").alias("duty_columns"))
    tall = rows.groupBy(*by).agg(F.count_if(F.col("role") == "data").alias("data_rows"))
    axes = dims.groupBy(*by).agg(F.count("*").alias("axes"))
    t = named.join(_dealt(tall), by).join(_dealt(body), by, "left").join(_dealt(duties), by, "left").join(_dealt(axes), by, "left")
    t = t.join(_dealt(leaf_section), by, "left") if leaf_section is not None else t.withColumn("section", F.lit(None).cast("string"))
    matrix = (F.col("data_rows") >= 2) & (F.col("width") >= 2) & ~F.col("synthetic") & ~F.col("defining") & ~F.col("requiring") & (F.col("firsts") >= 2) & (F.col("first_length") <= DIMENSION_LENGTH) & ~F.col("numbered")
    matrix = matrix & (F.col("markers") / F.col("bodies") >= MARKER_RATIO) & F.col("axes").isNotNull()
    prose = (F.col("filled") >= 2) & (F.col("duty_columns") >= 2) & (F.col("length") > PROSE_LENGTH)
    parameter = (F.col("data_rows") > 0) & ~F.col("defining") & F.col("requiring") & ~F.coalesce(F.col("section").rlike(TERMS_SECTION), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    return t.select(*by, F.when(no(matrix), "mapping_matrix").when(no(prose), "prose_grid").when(no(parameter), "parameter").otherwise("other").alias("kind"))


# --- leaves


def leaves(found: DataFrame, rows: DataFrame, heads: DataFrame, dims: DataFrame, kind: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Filled cells that no range covers, with leaf (cell, row or context) and candidate (what is to be reviewed, else null)."""
    over = covered(ranges, by).where("r <> r1 or c <> c1").select(*by, "r", "c")
    d = found.where("text <> ''").join(_dealt(over), [*by, "r", "c"], "left_anti")
    d = d.join(_dealt(rows.select(*by, "r", "role", "ambiguous", "group_header")), [*by, "r"]).join(_dealt(heads), [*by, "c"]).join(_dealt(kind), by)
    d = d.join(_dealt(dims.select(*by, "c", F.lit(True).alias("axis"))), [*by, "c"], "left").withColumn("axis", F.coalesce("axis", F.lit(False)))
    weak = F.col("signal") == "sentence_shape"
    strict = F.when(F.col("ambiguous"), F.when(F.col("technical"), "cell").otherwise("context")).when(F.col("untyped") | F.col("marker"), "context").when(F.col("strong") | F.col("technical"), "cell").otherwise("context")
    matrix = F.col("kind") == "mapping_matrix"
    context = F.col("untyped") | ((F.col("c") == 1) & (matrix | ~F.col("normative"))) | (matrix & F.col("header").rlike(records.NOTE_HEADER)) | (matrix & F.col("marker") & ~F.col("axis")) | weak
    by_cell = F.when(context, "context").otherwise("cell")
    several = sentences.normative_count(F.col("text")) >= 2
    by_row = F.when(F.col("axis") & F.col("marker"), "cell").when(F.col("untyped"), "context").when(several, "cell")
    plan = F.when(F.col("role") != "data", strict).when(F.col("group_header"), "context").when(F.col("kind").isin("mapping_matrix", "prose_grid"), by_cell).otherwise(by_row)
    d = d.withColumn("leaf", plan)
    line = Window.partitionBy(*by, "r")
    open_ = F.col("leaf").isNull()
    d = d.withColumns({"open_cells": F.count_if(open_).over(line), "open_duty": F.max((open_ & F.col("normative")).cast("int")).over(line), "open_meta": F.max((open_ & F.col("metadata")).cast("int")).over(line), "last_cell": F.max(F.when(F.col("leaf") == "cell", F.col("c"))).over(line)})
    eligible = (F.col("open_duty") == 1) | ((F.col("kind") == "parameter") & (F.col("open_cells") >= 2))
    d = d.withColumn("open", open_).withColumn("leaf", F.coalesce("leaf", F.when(eligible, "row").otherwise("context")))
    identity = ~F.col("marker") & (F.length("text") <= IDENTITY_LENGTH) & F.coalesce(F.col("c") < F.col("last_cell"), F.lit(False))
    silent = F.col("open") & (F.col("leaf") == "context") & (F.col("open_meta") == 0) & (F.col("signal") == "none") & ~identity
    # a weak sentence counts where it fell to context, but for cells set aside before the signal was asked
    aside = (F.col("role") == "data") & F.col("kind").isin("mapping_matrix", "prose_grid") & ((F.col("c") == 1) | (matrix & F.col("header").rlike(records.NOTE_HEADER)))
    fell = (F.col("leaf") == "context") & weak & ~F.col("group_header") & ~aside
    candidate = (
        F.when((F.col("role") != "data") & F.col("ambiguous"), "ambiguous_structure")
        .when(fell, "weak_signal")
        .when(silent, "unsignaled_data")
        .when(F.col("untyped") & ~F.col("group_header"), "untyped_colon_spec")
    )
    return d.withColumn("candidate", candidate).drop("open_cells", "open_duty", "open_meta", "last_cell", "open", "axis")


def leaf_modes(planned: DataFrame, by: list[str]) -> DataFrame:
    """by, mode: mixed, cell or row."""
    has = lambda x: F.bool_or(F.col("leaf") == x)
    return planned.groupBy(*by).agg(F.when(has("row") & has("cell"), "mixed").when(has("cell"), "cell").otherwise("row").alias("mode"))


def structural_role(role: Column, group_header: Column, kind: Column, c: Column) -> Column:
    return F.when(role != "data", role).when(group_header, "group_header").when(kind.isin("mapping_matrix", "prose_grid") & (c == 1), "row_header").otherwise("data")


def cell_items(planned: DataFrame, cells: DataFrame, rows: DataFrame, ranges: DataFrame, by: list[str], id_of: Column) -> DataFrame:
    """One item for each planned cell: id, structural role, spans, group header above, and the identifying cells to its left.

    id_of: the text of the table's id. A covered cell to the left stands for the first cell of its range.
    """
    span = normal_ranges(ranges).groupBy(*by, F.col("r1").alias("r"), F.col("c1").alias("c")).agg(F.min(F.struct("r2", "c2")).alias("to"))
    d = planned.join(_dealt(span), [*by, "r", "c"], "left")
    heading = rows.select(*by, "r", F.when(F.col("group_header") & (F.col("role") == "data"), F.col("first")).alias("g"))
    above = heading.withColumn("above", F.last("g", True).over(Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "r", "above")
    d = d.join(_dealt(above), [*by, "r"]).withColumn("srole", structural_role(F.col("role"), F.col("group_header"), F.col("kind"), F.col("c")))
    # values to the left: own ones, and those inherited through a covered place
    over = covered(ranges, by).where("r <> r1 or c <> c1").select(*by, "r", "c", "r1", "c1")
    firsts = over.select(*by, F.col("r1").alias("r"), F.col("c1").alias("c")).distinct()
    anchor = facts(cells.join(_dealt(firsts), [*by, "r", "c"], "left_semi"), by).where("text <> ''").select(*by, F.col("r").alias("r1"), F.col("c").alias("c1"), "text", "marker", "strong")
    kind = planned.select(*by, "kind").distinct()
    inherited = over.join(_dealt(anchor), [*by, "r1", "c1"]).join(_dealt(rows.select(*by, "r", "role", "group_header")), [*by, "r"]).join(_dealt(kind), by)
    inherited = inherited.withColumn("srole", structural_role(F.col("role"), F.col("group_header"), F.col("kind"), F.col("c")))
    use = ~F.col("marker") & ((F.col("srole") == "row_header") | ((F.length("text") <= IDENTITY_LENGTH) & ~F.col("strong")))
    seen = d.select(*by, "r", "c", F.when(use, F.col("text")).alias("v"), F.lit(True).alias("own")).unionByName(inherited.select(*by, "r", "c", F.when(use, F.col("text")).alias("v"), F.lit(False).alias("own")))
    seen = seen.withColumn("left", F.collect_list("v").over(Window.partitionBy(*by, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))).where("own").select(*by, "r", "c", "left")
    d = d.join(_dealt(seen), [*by, "r", "c"])
    id_ = F.concat(id_of, F.lit("-R"), F.lpad(F.col("r").cast("string"), 6, "0"), F.lit("-C"), F.lpad(F.col("c").cast("string"), 6, "0"))
    return d.select(
        *by,
        "r",
        "c",
        id_.alias("cell_id"),
        F.col("srole").alias("structural_role"),
        (F.coalesce(F.col("to.r2") - F.col("r"), F.lit(0)) + 1).alias("row_span"),
        (F.coalesce(F.col("to.c2") - F.col("c"), F.lit(0)) + 1).alias("column_span"),
        "text",
        F.col("header"),
        F.array_compact(F.concat(F.array("above"), "left")).alias("row_header_context"),
        F.col("normative").alias("requirement_like"),
        "leaf",
        "candidate",
        "kind",
    )
