"""Object models: objects from their rows, attributes with the object they belong to, and instances by sessions of table rows.

Objects and attributes of a document meet by name, by table, by the number of a table before, or by class, each an equal join;
every pair gets the rank of the rule that made it, and the best pair of an attribute stays. Work grows with the rows of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records
from clausework.sources.store import written

# fixed values
CLASS_IDS = {
    "Data": "1", "Register": "3", "Extended Register": "4", "Demand Register": "5", "Register Activation": "6", "Profile Generic": "7", "Clock": "8", "Script Table": "9",
    "Schedule": "10", "Special Days Table": "11", "Association SN": "12", "Association LN": "15", "SAP Assignment": "17", "Image Transfer": "18", "Activity Calendar": "20",
    "Single Action Schedule": "22", "Register Table": "61", "Compact Data": "62", "Security Setup": "64", "Disconnect Control": "70",
}
CLASS_ATTRIBUTES = {
    "Data": ("logical_name", "value", "device_operation", "modem_versions", "devAddr", "join_strategy", "multicasts_parameters", "disconnect_from_network()", "change_class(data)", "change_region(data)"),
    "Register": ("logical_name", "value", "scaler_unit"),
    "Extended Register": ("logical_name", "value", "scaler_unit", "status", "capture_time", "reset"),
    "Demand Register": ("logical_name", "current_average_value", "last_average_value", "scaler_unit", "status", "capture_time", "start_time_current", "period", "number_of_periods", "reset", "next_period"),
    "Profile Generic": ("logical_name", "buffer", "capture_objects", "capture_period", "sort_method", "sort_object", "entries_in_use", "profile_entries", "reset", "capture"),
    "Association LN": (
        "logical_name", "object_list", "associated_partners_id", "application_context_ name", "xDLMS_context_info", "authentication_mechanism_name", "LLS_secret", "association_status",
        "Security setup reference", "User_list", "current_user", "N_successive_ password_errors", "Time_without_ communication", "change_HLS_secret (date)", "add_object(date)",
        "remove_object(date)", "add_user (date)", "remove_user (date)",
    ),
    "Script Table": ("logical_name", "scripts", "execute"),
    "Single Action Schedule": ("logical_name", "executed_script", "type", "execution_time"),
    "Register Table": ("logical_name", "table_cell_values", "table_cell_definition", "capture"),
    "Compact Data": ("logical_name", "compact_buffer", "capture_objects", "template_id", "template_description", "capture_method"),
    "Security Setup": (
        "logical_name", "reply_to_HLS_ authentication (data)", "security policy", "security suite", "client system title", "server system title", "Certificates", "security activate",
        "key transfer", "Key agreement", "Generate Key pair", "Generate certificate request", "Import certificate", "Export certificate", "Remove certificate",
    ),
    "Disconnect Control": ("logical_name", "output_state", "control_state", "control_mode", "remote_disconnect", "remote_connect"),
}
PROFILE_ONLY = ("buffer", "capture_objects", "capture_period", "sort_method", "sort_object", "entries_in_use", "profile_entries")
CONTINUATION = r"(?i)(?:\bcontinued\b|\bcontinuation\b|\bcont\.?\b|续表)"
BACK = 3


def attribute_key(name: Column) -> Column:
    return F.lower(F.array_join(F.filter(F.split(F.translate(F.coalesce(name, F.lit("")), "-", "_"), r"\s+"), lambda x: x != ""), "_"))


def plain_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), ".", " "), r"\s+", " ")))


def _allowed() -> Column:
    """class id -> normal forms of the attributes that its class has."""
    key = lambda x: "_".join(x.replace("-", "_").split()).lower()
    return F.create_map(*(y for name, attrs in CLASS_ATTRIBUTES.items() for y in (F.lit(CLASS_IDS[name]), F.array(*(F.lit(key(a)) for a in attrs)))))


def class_has(class_id: Column, attribute: Column) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(_allowed(), F.coalesce(class_id, F.lit(""))), attribute_key(attribute)), F.lit(False))


def canonical_attribute(parent: Column, name: Column) -> Column:
    """The spelling of a class's attribute where the parent is a class; else the name as it is."""
    out = name
    for cls, attrs in CLASS_ATTRIBUTES.items():
        for a in attrs:
            out = F.when((parent == cls) & (attribute_key(name) == "_".join(a.replace("-", "_").split()).lower()), a).otherwise(out)
    return out


def objects_of(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(objects, conflicts) of rows (by, ord, name, codes, class_id, item_id, tbl, row): one object for each name, code, class and source row."""
    r = rows.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    codes = records.object_codes(F.col("codes"))
    r = r.withColumn("code", F.explode(F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("")))))
    key = [*by, "name", "code", "class_id", "item_id"]
    n = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    r = r.withColumn("_n", n)
    return r.where("_n = 1").drop("_n", "codes"), r.where("_n > 1").select(*by, "name", "code", "class_id")


def _pairs(attrs: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """All pairs that a rule may choose: by, aid, oid, and the columns of both."""
    number = lambda t: F.when(F.col(t).rlike(r"\d$"), F.regexp_extract(t, r"(\d+)$", 1).cast("long"))
    a = attrs.withColumns({"an": number("tbl"), "ak": attribute_key(F.col("attr")), "ap": plain_name(F.col("parent"))}).withColumnsRenamed({"tbl": "at", "row": "ar", "ord": "ao"})
    o = objects.select(*by, "oid", "name", "class_id", F.col("tbl").alias("ot"), F.col("row").alias("orow"), F.col("ord").alias("oo")).withColumn("on_", number("ot"))
    cols = [c for c in a.columns] + [c for c in o.columns if c not in by]
    same_name = a.join(o.withColumn("parent", F.col("name")), [*by, "parent"]).select(cols)
    same_table = a.join(o.withColumn("at", F.col("ot")), [*by, "at"]).select(cols)
    before = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(BACK)))).withColumn("on_", F.col("an") - F.col("k")).drop("k").join(o, [*by, "on_"]).select(cols)
    ids = F.create_map(*(F.lit(x) for p in CLASS_IDS.items() for x in p))
    lone = o.groupBy(*by, "class_id").agg(F.count("*").alias("_n"), F.max("oid").alias("oid")).where("_n = 1").select(*by, "class_id", "oid")
    of_class = a.withColumn("class_id", F.try_element_at(ids, F.col("parent"))).where("class_id is not null").join(lone, [*by, "class_id"]).select(*[c for c in a.columns], "oid").join(o, [*by, "oid"]).select(cols)
    return same_name.unionByName(same_table).unionByName(before).unionByName(of_class).dropDuplicates([*by, "aid", "oid"])


def parents(attrs: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """by, aid, oid, rule: the object of each attribute, by the first rule that finds one; attributes without one are left out.

    attrs: by, aid, ord, parent, attr, tbl, row. objects: by, oid, ord, name, class_id, tbl, row. Rules: 1 the name, above in the table; 2 the
    name, before; 3 the name; 4 a name that begins so, above; 5 an attribute named as its parent, above; 6 the table before, by class;
    8 a table up to three back whose object has got such an attribute; 9 to 11 a class: above in the table, in the table before,
    or its only object; 12 the only or next object of the table whose class has the attribute.
    """
    p = _pairs(attrs, objects, by)
    above = (F.col("at") != "") & (F.col("ot") == F.col("at")) & (F.col("orow") <= F.col("ar"))
    earlier = (F.col("ot") < F.col("at")) | ((F.col("ot") == F.col("at")) & (F.col("orow") <= F.col("ar")))
    fits = ~(F.trim("attr").isin(*PROFILE_ONLY) & (F.coalesce("class_id", F.lit("")) != "7")) & ((F.coalesce("ot", F.lit("")) == "") | (F.coalesce("at", F.lit("")) == "") | (F.col("ot") == F.col("at")) | earlier)
    has, named = class_has(F.col("class_id"), F.col("attr")), F.col("name") == F.col("parent")
    ids = F.create_map(*(F.lit(x) for pair in CLASS_IDS.items() for x in pair))
    is_class = F.col("parent").isin(*CLASS_ATTRIBUTES)
    own_class = F.coalesce(F.try_element_at(ids, F.col("parent")) == F.col("class_id"), F.lit(False))
    begins = F.startswith(plain_name(F.col("name")), F.col("ap"))
    template = F.when(is_class, own_class | has).otherwise(~begins & has)
    one_back = F.coalesce(F.col("an") - F.col("on_") == 1, F.lit(False))
    by_class = is_class & own_class & class_has(F.col("class_id"), F.col("attr"))
    p = p.withColumns({"has": has, "fits": fits})
    w = Window.partitionBy(*by, "aid")
    mates = F.count_if(F.col("has") & F.col("fits") & (F.col("ot") == F.col("at"))).over(w)
    p = p.withColumn("mates", mates)
    rule = (
        F.when(named & above & F.col("fits"), 1)
        .when(named & earlier & F.col("fits"), 2)
        .when(named & F.col("fits"), 3)
        .when((F.col("parent") != "") & above & begins & F.col("has") & F.col("fits"), 4)
        .when(above & (attribute_key(F.col("parent")) == F.col("ak")) & F.col("has"), 5)
        .when(one_back & template & F.col("fits"), 6)
        .when(by_class & above & F.col("fits"), 9)
        .when(by_class & one_back & F.col("fits"), 10)
        .when(by_class, 11)
        .when((F.col("ot") == F.col("at")) & F.col("has") & F.col("fits") & ((F.col("mates") == 1) | (F.col("orow") > F.col("ar"))), 12)
    )
    p = p.withColumn("rule", rule)
    order = [F.asc("rule"), F.desc(F.when(F.col("rule") == 2, F.col("ot"))), F.asc(F.when(F.col("rule") == 3, F.col("oo"))), F.asc(F.when(F.col("rule") == 12, F.col("orow"))), F.desc("orow"), F.asc("oo")]
    p = written(p, "pairs")
    # rule 11 takes the only object of its class in the document
    lone = objects.groupBy(*by, "class_id").agg(F.count("*").alias("_n")).where("_n = 1").select(*by, "class_id", F.lit(True).alias("_lone"))
    first = p.where("rule is not null").join(lone, [*by, "class_id"], "left").where("rule <> 11 or _lone")
    best = written(first.withColumn("i", F.row_number().over(w.orderBy(*order))).where("i = 1").select(*by, "aid", "oid", "rule", F.col("ao"), F.col("ak"), "ot"), "parents")
    # a table without objects of its own continues the last one, up to three back, whose object has got such an attribute before
    near = best.where("rule <= 6").select(*by, F.col("oid"), F.col("ak"), F.col("ao").alias("got")).groupBy(*by, "oid", "ak").agg(F.min("got").alias("got"))
    own = objects.select(*by, F.col("tbl").alias("at")).distinct().withColumn("_own", F.lit(1))
    back = p.where(F.col("has") & (F.col("an") - F.col("on_")).between(1, BACK)).join(near, [*by, "oid", "ak"]).where("got < ao").join(own, [*by, "at"], "left").where("_own is null")
    back = back.withColumn("i", F.row_number().over(w.orderBy(F.asc(F.col("an") - F.col("on_")), F.desc("orow")))).where("i = 1").select(*by, "aid", "oid", F.lit(8).alias("rule"))
    both = best.select(*by, "aid", "oid", "rule").unionByName(back)
    return both.withColumn("i", F.row_number().over(w.orderBy("rule"))).where("i = 1").drop("i")


def model_counts(objects: DataFrame, conflicts: DataFrame, attrs: DataFrame, found: DataFrame, units: DataFrame) -> DataFrame:
    """One row: objects, attributes, attached, orphans, units, conflicts."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(objects, "objects").join(n(attrs, "attributes")).join(n(found, "attached")).join(n(units, "units")).join(n(conflicts, "conflicts"))
    return out.withColumn("orphans", F.col("attributes") - F.col("attached"))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), CONTINUATION, ""), r"^[ \-:()]+|[ \-:()]+$", "")


def instances(items: DataFrame, by: list[str]) -> DataFrame:
    """items (by, ord, tbl, title, section, continued_from, fields) with `instance` (its number, null outside) and `is_header`.

    An object header opens an instance; it goes on through the rows of its table and of tables that continue it: told so, or of the same
    section and base title, alike or marked as continued.
    """
    w = Window.partitionBy(*by).orderBy("ord")
    t = F.trim(F.coalesce("title", F.lit("")))
    before = lambda c: F.lag(c).over(w)
    now, last = F.coalesce("tbl", F.lit("")), F.coalesce(before("tbl"), F.lit(""))
    told = (F.coalesce("continued_from", F.lit("")) != "") & (F.col("continued_from") == last)
    alike = (F.lower(t) == F.lower(F.coalesce(before("title"), F.lit("")))) | t.rlike(CONTINUATION)
    goes_on = F.coalesce("section", F.lit("")).eqNullSafe(F.coalesce(before("section"), F.lit(""))) & (t != "") & (F.coalesce(before("title"), F.lit("")) != "") & (title_key(F.col("title")) == title_key(before("title"))) & alike
    same = (now == last) | F.when((now == "") | (last == ""), F.lit(False)).otherwise(told | goes_on)
    head = records.is_object_header(F.col("fields"))
    e = items.withColumns({"is_header": head, "_cut": F.coalesce(~same, F.lit(True)) & before("tbl").isNotNull()})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"_h": F.sum(F.col("is_header").cast("int")).over(run), "_lh": F.max(F.when(F.col("is_header"), F.col("ord"))).over(run), "_lc": F.max(F.when(F.col("_cut"), F.col("ord"))).over(run)})
    inside = F.col("_lh").isNotNull() & (F.col("_lc").isNull() | (F.col("_lc") <= F.col("_lh")))
    return e.withColumn("instance", F.when(inside, F.col("_h"))).drop("_cut", "_h", "_lh", "_lc")
