"""Requirement candidates from paragraphs, table rows and cells: rules that each give a row or none, and the union of them.

items: item_id, block_id, title, row_index, fields (map), tags (array), object_name, class_id, obis (of the object above, null
without). Every rule is an expression over one row, so the union is one scan; duplicates are dropped by a grouped minimum and ids are
dealt range by range, with no window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records, rules, scalars, sentences
from clausework.operators import tables
from clausework.sources.store import written

# fixed values
SECURITY_TERMS = ("hls", "lls", "without security", "security")


def _v(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _row(kind: str, requirement_type, requirement: Column, obj: Column, method, confidence, ambiguous) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("source_type"),
        lit(requirement_type).alias("requirement_type"),
        scalars.clean(requirement).alias("requirement"),
        obj.alias("object"),
        lit(method).alias("verification_method"),
        lit(confidence).cast("double").alias("confidence"),
        lit(ambiguous).cast("boolean").alias("ambiguity"),
    )


def _f(header: str) -> Column:
    return records.field(F.col("fields"), header)


def _first(*headers: str) -> Column:
    return F.coalesce(*(F.nullif(_f(h), F.lit("")) for h in headers), F.lit(""))


def _phrase() -> Column:
    """Object name, class and code of the object above, with slashes."""
    bits = (F.nullif(F.col("object_name"), F.lit("")), F.concat(F.lit("CL "), F.nullif(F.col("class_id"), F.lit(""))), F.concat(F.lit("OBIS "), F.nullif(F.col("obis"), F.lit(""))))
    return F.concat_ws(" / ", *bits)


def matrix_rows() -> Column:
    """One row for each marked fact in `facts` (subject, predicate_header)."""
    use = lambda f: (scalars.clean(f["subject"]) != "") & (records.table_header(f["predicate_header"]) != "")
    text = lambda f: F.concat(scalars.clean(f["subject"]), F.lit(" shall support "), records.table_header(f["predicate_header"]), F.lit("."))
    return F.transform(F.filter("facts", use), lambda f: _row("table_matrix_fact", "capability_matrix", text(f), scalars.clean(f["subject"]), "configuration_check", 0.82, False))


def valued_rows() -> Column:
    def one(f: Column) -> Column:
        text = F.concat(f["subject"], F.lit(" shall have "), records.table_header(f["predicate_header"]), F.lit(" set to "), f["value"], F.lit("."))
        said = records.match_term(F.concat_ws(" ", _v(F.col("title")), f["predicate_header"], f["value"]))
        secure = F.lit(False)
        for term in SECURITY_TERMS:
            secure = secure | F.contains(said, F.lit(term))
        kind = F.when(secure, "association_security_matrix").otherwise("table_value_matrix")
        return _row("table_valued_matrix_fact", kind, text, f["subject"], "configuration_check", 0.8, rules.is_ambiguous(f["value"]))

    return F.transform(records.valued_facts(F.col("fields")), one)


def object_row() -> Column:
    name, code = _f("Object/attribute name"), _f("Value")
    bits = F.concat_ws(" / ", name, F.concat(F.lit("CL "), records.intish(_f("CL"))), F.concat(F.lit("OBIS "), code))
    row = _row("cosem_object_row", "cosem_object_instance", F.concat(F.lit("COSEM object "), bits, F.lit(" shall be defined by the profile.")), name, "configuration_check", 0.88, False)
    return F.when(records.is_object_header(F.col("fields")) & (code != ""), row)


def attribute_row() -> Column:
    name, rights = _f("Object/attribute name"), _f("Access rights RC/PC/SC/LC")
    guessed = records.object_name(F.array().cast("array<struct<type:string,name:string>>"), name)
    owner = F.coalesce(F.nullif("object_name", F.lit("")), F.nullif(guessed, F.lit("")), F.lit(""))
    qualified = F.when(owner != "", F.concat_ws(".", owner, name)).otherwise(name)
    bits = F.concat_ws(" / ", F.nullif(owner, F.lit("")), F.concat(F.lit("CL "), F.nullif("class_id", F.lit(""))), F.concat(F.lit("OBIS "), F.nullif("obis", F.lit(""))))
    text = F.concat(F.lit("COSEM attribute "), qualified, F.when(bits != "", F.concat(F.lit(" for "), bits)).otherwise(""), F.lit(" shall use access rights "), rights, F.lit("."))
    row = _row("cosem_attribute_row", "cosem_attribute_access", text, qualified, "configuration_check", F.when(owner != "", 0.9).otherwise(0.82), False)
    return F.when(records.is_attribute_row(F.col("fields")) & (rights != ""), row)


def event_row() -> Column:
    group, sub, number = _f("Group number"), _f("Subgroup number"), _first("Event number", "Number of event")
    said = _first("Description of the event", "Event description", "Event subgroup description")
    or_q = lambda c: F.when(c == "", "?").otherwise(c)
    name = F.concat(F.lit("Event G"), or_q(group), F.lit("-SG"), or_q(sub), F.lit("-E"), number)
    row = _row("event_table_row", "event_definition", F.concat(name, F.lit(" shall be defined as: "), said, F.lit(".")), name, "document_review", 0.84, rules.is_ambiguous(said))
    told = (group != "") | (sub != "") | F.contains(F.lower(_v(F.col("title"))), F.lit("event"))
    return F.when((number != "") & (said != "") & told, row)


def event_group_row() -> Column:
    group, sub, least = _f("Group number"), _f("Subgroup number"), _f("Minimum records")
    said = _first("Description of the event", "Event subgroup description")
    name = F.concat(F.lit("Event subgroup G"), group, F.lit("-SG"), sub)
    text = F.concat(name, F.lit(" shall keep at least "), least, F.lit(" records for "), said, F.lit("."))
    return F.when((group != "") & (sub != "") & (least != ""), _row("event_group_row", "event_group_retention", text, name, "configuration_check", 0.86, rules.is_ambiguous(said)))


def suite_row() -> Column:
    number, name = _f("ID"), _f("Name")
    row = _row("security_suite_row", "security_suite_definition", F.concat(F.lit("Security suite "), number, F.lit(" shall be defined as "), name, F.lit(".")), F.concat(F.lit("Security suite "), number), "document_review", 0.86, False)
    return F.when((number != "") & (name != "") & F.contains(F.lower(_v(F.col("title"))), F.lit("security")), row)


def _defined(first: str, second: str, label: str, kind: str, requirement_type: str, method: str, confidence: float) -> Column:
    a, b = _f(first), _f(second)
    name = F.concat(F.lit(label), a)
    return F.when((a != "") & (b != ""), _row(kind, requirement_type, F.concat(name, F.lit(" shall be defined as: "), b, F.lit(".")), name, method, confidence, rules.is_ambiguous(b)))


def policy_bit_row() -> Column:
    return _defined("bit", "Security Policy - Security States", "Security policy bit ", "security_policy_bit_row", "security_policy_bit", "configuration_check", 0.86)


def policy_state_row() -> Column:
    return _defined("State", "Security policy", "Security policy state ", "security_policy_state_row", "security_policy_state", "configuration_check", 0.84)


def quantity_row() -> Column:
    group, quantity, unit = _f("Greatness"), _f("Greatness_2"), _f("Unit")
    text = F.concat(F.lit("Measurement quantity "), quantity, F.lit(" shall use unit "), unit, F.lit("."))
    return F.when((group != "") & (quantity != "") & (unit != ""), _row("measurement_quantity_row", "measurement_quantity_unit", text, quantity, "document_review", 0.82, False))


def flag_row() -> Column:
    flag, said = _f("Flag"), _f("Description")
    name = F.when(_v(F.col("title")) != "", F.concat_ws(": ", "title", flag)).otherwise(flag)
    return F.when((flag != "") & (said != ""), _row("flag_definition_row", "flag_definition", F.concat(name, F.lit(" shall be defined as: "), said, F.lit(".")), name, "document_review", 0.8, rules.is_ambiguous(said)))


def whole_row() -> Column:
    text = F.array_join(F.filter(F.map_values("fields"), lambda x: _v(x) != ""), " | ")
    none = F.array().cast("array<struct<type:string,name:string>>")
    row = _row("table_row", rules.requirement_type(text, F.col("tags")), text, records.object_name(none, text), rules.verification_method(text, F.col("tags")), 0.74, rules.is_ambiguous(text))
    return F.when(rules.is_atomic_like(text), row)


def of_rows(items: DataFrame) -> DataFrame:
    """source_id, pos and a candidate for each rule that a table row meets, in the order of the rules. items may have `facts`."""
    if "facts" not in items.columns:
        items = items.withColumn("facts", F.array().cast("array<struct<subject:string,predicate_header:string>>"))
    single = (object_row, attribute_row, event_row, event_group_row, suite_row, policy_bit_row, policy_state_row, quantity_row, flag_row, whole_row)
    found = F.concat(matrix_rows(), valued_rows(), F.array_compact(F.array(*(f() for f in single))))
    return items.select(F.col("item_id").alias("source_id"), F.posexplode(found).alias("pos", "x")).select("source_id", "pos", "x.*")


def of_paragraphs(blocks: DataFrame) -> DataFrame:
    """source_id, pos, condition and a candidate for each strict requirement sentence of blocks (block_id, text, tags)."""
    b = blocks.select(F.col("block_id").alias("source_id"), "tags", F.posexplode(sentences.contexts(F.col("text"))).alias("pos", "c"))
    b = b.where(rules.is_atomic_like(F.col("c.sentence")))
    text, none = F.col("c.sentence"), F.array().cast("array<struct<type:string,name:string>>")
    row = _row("paragraph", rules.requirement_type(text, F.col("tags")), text, records.object_name(none, text), rules.verification_method(text, F.col("tags")), 0.68, rules.is_ambiguous(text))
    return b.select("source_id", "pos", row.alias("x"), sentences.condition(F.col("c.prev")).alias("condition")).select("source_id", "pos", "x.*", "condition")


def of_cells(cells: DataFrame) -> DataFrame:
    """Candidates of cell leaves: a marked cell of a fact column says what its row supports, other normative cells speak for themselves.

    cells: cell_id, text, leaf, kind, structural_role, axis (whether the column names a dimension), header, context (identifying
    cells, the last is the subject), requirement_like, tags.
    """
    subject, predicate = scalars.clean(F.element_at("context", -1)), records.table_header(F.col("header"))
    marked = F.col("axis_table") & rules.is_marker(F.col("text"))
    real = (subject != "") & (predicate != "") & ~rules.is_marker(subject) & ~rules.is_marker(predicate) & ~subject.rlike(tables.NUMERIC)
    real = real & (F.length(subject) <= tables.DIMENSION_LENGTH) & ~rules.is_normative(subject)
    fact = _row("table_cell", "capability_matrix", F.concat(subject, F.lit(" shall support "), predicate, F.lit(".")), subject, "configuration_check", 0.82, False)
    none = F.array().cast("array<struct<type:string,name:string>>")
    own = _row("table_cell", rules.requirement_type(F.col("text"), F.col("tags")), F.col("text"), records.object_name(none, F.col("text")), rules.verification_method(F.col("text"), F.col("tags")), 0.7, rules.is_ambiguous(F.col("text")))
    x = F.when(marked, F.when((F.col("structural_role") == "data") & F.col("axis") & F.coalesce(real, F.lit(False)), fact)).when(F.col("requirement_like"), own)
    c = cells.withColumn("axis_table", (F.col("kind") == "mapping_matrix") | F.coalesce("has_axes", F.lit(False))) if "has_axes" in cells.columns else cells.withColumn("axis_table", F.col("kind") == "mapping_matrix")
    return c.where("leaf = 'cell' and text <> ''").select(F.col("cell_id").alias("source_id"), F.lit(0).alias("pos"), x.alias("x")).where("x is not null").select("source_id", "pos", "x.*")


def numbered(df: DataFrame, order: list[str], prefix: str, name: str) -> DataFrame:
    """df with prefix and a number of six digits from 1 in the stated order: ranges are counted first, so no task sees all rows."""
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = {r["_part"]: r["count"] for r in laid.groupBy("_part").count().collect()}  # one row a partition
    offset, at = {}, 0
    for part in sorted(counts):
        offset[part], at = at, at + counts[part]
    starts = F.create_map(*(F.lit(x) for pair in (offset or {0: 0}).items() for x in pair))
    i = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.element_at(starts, F.col("_part"))
    digits = i.cast("string")
    return laid.withColumn(name, F.concat(F.lit(prefix), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))).drop("_part")


def union(candidates: list[DataFrame]) -> DataFrame:
    """All candidates, the first of each source, type and normal text, with req_id in order and a stable id. Sources stand in the given order."""
    cols = ["source_id", "pos", "source_type", "requirement_type", "requirement", "object", "verification_method", "confidence", "ambiguity"]
    all_ = None
    for i, c in enumerate(candidates):
        c = c.select(F.lit(i).alias("src"), *cols)
        all_ = c if all_ is None else all_.unionByName(c)
    key = records.match_term(F.col("requirement"))
    rest = [c for c in cols if c not in ("source_id", "requirement_type")]
    first = all_.withColumn("_k", key).groupBy("source_id", "requirement_type", "_k").agg(F.min_by(F.struct("src", *rest), F.struct("src", "pos")).alias("x"))
    out = numbered(first.select("source_id", "requirement_type", "x.*"), ["src", "source_id", "pos"], "AREQ-", "req_id")
    return out.withColumn("stable_req_id", records.stable_id(F.col("source_id"), F.col("requirement_type"), F.col("requirement")))


def tasks(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """task_id, task_type, source_id: chunks, then rows, that are requirement-like or have a tag."""
    use = F.coalesce(F.col("requirement_like"), F.lit(False)) | (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)
    a = chunks.where(use).select(F.lit(0).alias("src"), F.lit("extract_atomic_requirements").alias("task_type"), F.col("chunk_id").alias("source_id"))
    b = items.where(use).select(F.lit(1).alias("src"), F.lit("classify_table_atom").alias("task_type"), F.col("item_id").alias("source_id"))
    return numbered(a.unionByName(b), ["src", "source_id"], "TASK-", "task_id").drop("src")


def object_above(items: DataFrame, by: list[str]) -> DataFrame:
    """items with object_name, class_id and obis of the object header that stands at or above the row in its table."""
    here = records.is_object_header(F.col("fields"))
    seen = F.last(F.when(here, F.struct(_f("Object/attribute name").alias("n"), records.intish(_f("CL")).alias("c"), _f("Value").alias("o"))), True)
    at = Window.partitionBy(*by).orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_o", seen.over(at)).select(*items.columns, F.col("_o.n").alias("object_name"), F.col("_o.c").alias("class_id"), F.col("_o.o").alias("obis"))
