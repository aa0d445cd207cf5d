"""Rows whose results are known by the rules themselves: borders of terms, quotes, codes, units, tables and routes."""

import pytest
from pyspark.sql import functions as F

from clausework.functions import catalog, guards, records, routing, sentences, tender
from clausework.operators import consistency, knowledge, ledgers, objects, tables


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("terms", "text", "found"),
    [
        (["rf"], "interface performance", []),
        (["rf"], "an RF profile", ["rf"]),
        (["prime", "event"], "a primary rule to prevent it", []),
        (["prime", "event"], "events are kept", ["event"]),
        (["register"], "registers and registered", ["register"]),
        (["0-0:"], "name 0-0:1.0.0.255", ["0-0:"]),
        (["load profile"], "an overload profile", []),
        (["load profile", "profile"], "a LOAD　PROFILE and a profile", ["load profile", "profile"]),
        (["曲线"], "负荷曲线 2", ["曲线"]),
        ([], "anything", []),
    ],
)
def test_terms(spark, terms, text, found):
    assert one(spark, knowledge.matched_terms(records.match_term(F.lit(text)), F.array(*map(F.lit, terms)).cast("array<string>"))) == [found]


def test_repeats_and_codes(spark):
    rows = spark.createDataFrame([("a", "The meter shall keep  all energy.", "4.1"), ("b", "the meter SHALL keep all energy.", "7.3"), ("c", "see 4.2", "1"), ("d", "see 4.2", "2")], "id string, quote string, section string")
    assert [tuple(r) for r in consistency.duplicates(rows, "id", "quote", "section").collect()] == [("the meter shall keep all energy.", ["a", "b"], ["4.1", "7.3"], 2)]
    codes = spark.createDataFrame([("a", "log 0-0:99.98.0.255 keeps 100 rows", "4"), ("b", "0-0:99.98.0.255 of high rank", "5"), ("c", "1-0:1.8.0.255", ""), ("d", "read 1-0:1.8.0.255", None), ("e", "9-9:1.1.1.1", "4")], "id string, quote string, section string")
    got = {r.code: (r.members, r.sections, r.values_differ) for r in consistency.coreferences(codes, "id", "quote", "section").collect()}
    assert got == {"0-0:99.98.0.255": (["a", "b"], ["4", "5"], True), "1-0:1.8.0.255": (["c", "d"], [], False)}


def test_quote_edges(spark):
    blocks = spark.createDataFrame([(1, 1, "b1", "First long sentence here", False), (1, 2, "b2", "x", False), (1, 3, "b3", "Second long sentence", False), (1, 4, "b4", "Third long sentence", False), (1, 5, "n", "watermark of a tool", True), (2, 1, "c", None, None)], "doc int, ord int, block_id string, text string, noise boolean")
    quotes = [(1, 1, "long sentence here Second long"), (1, 2, "Second long sentence Third long"), (1, 3, None), (1, 4, "first long\nsentence here...watermark of a tool"), (2, 5, "First long sentence here"), (3, 6, "First long sentence here")]
    q = spark.createDataFrame(quotes, "doc int, rid int, quote string")
    got = {r.rid: (r.block_ids, r.method) for r in consistency.match_quotes(q, blocks, "doc", "rid", "quote").collect()}
    assert got == {1: ([], ""), 2: (["b3", "b4"], "multi_block"), 3: ([], ""), 4: (["b1"], "contains"), 5: ([], ""), 6: ([], "")}


def test_sentences(spark):
    lit = F.lit
    assert one(spark, sentences.parts(lit("See fig. 3.5 e.g. here. Next! (end)?  "))) == [["See fig. 3.5 e.g. here. ", "Next! ", "(end)?  "]]
    assert one(spark, sentences.parts(lit("... a.b is. !!! ")), sentences.parts(lit("")), sentences.parts(lit("?!")), sentences.parts(lit(None).cast("string"))) == [["... a.b is. !!! "], [], ["?!"], []]
    assert one(spark, sentences.normative_count(lit("It shall go. It  shall go. It must stop. A note."))) == [2]
    assert one(spark, sentences.fragments(lit("a b. c d\ne")), sentences.fragments(lit(" ")), sentences.of_paragraph(lit("a;b; c! d"))) == [["a b.", "c d", "e"], [], ["a;b;", "c!", "d"]]
    assert [tuple(x) for x in one(spark, sentences.spans(lit("Ab. C")))[0]] == [(0, 4), (4, 5)]


def test_numbers_and_units(spark):
    lit = F.lit
    assert one(spark, guards.produced_ints(lit("3,200 of 1 008")), guards.source_ints(lit("twelve and the third 4,000"))) == [["1008", "3200"], ["000", "12", "3", "4", "4000"]]
    assert [tuple(x) for x in one(spark, guards.unit_values(lit("at 5 V, 5,5V and 20mA2 or 3 bar")))[0]] == [("bar", "3"), ("ma", "20"), ("v", "5"), ("v", "5.5")]
    assert one(spark, guards.modal_inflation(lit("may not be used"), lit("必须")), guards.modal_inflation(lit("it may be used"), lit("必须"))) == [False, True]
    assert one(spark, guards.foreign_standards(lit("ISO 6270 and EN 14236"), lit("EN ISO 6270-1"))) == [["EN 14236"]]
    assert one(spark, guards.values_left_behind(lit("list"), lit("list 11 22 33 44"), lit("55")), guards.values_left_behind(lit("list"), lit("list 11 22"), lit(""))) == [4, 0]
    assert one(spark, catalog.periods_compatible(lit("every 15 min"), lit("15 minutes")), catalog.periods_compatible(lit("60 min"), lit("1 h")), catalog.periods_compatible(lit("none"), lit("1 h"))) == [True, False, True]
    assert one(spark, records.object_code(lit("1:0-1.8.0.255")), records.object_codes(lit("0-0:96 1 0 255 1-0:2.8.0.255")), records.intish(lit("007")), records.intish(lit(None).cast("string"))) == ["1-0:1.8.0.255", ["0-0:96.1.0.255", "1-0:2.8.0.255"], "7", None]
    assert one(spark, records.formula_safe(lit("-A--")), records.formula_safe(lit("+12,5%")), records.formula_safe(lit("=1+1")), records.formula_safe(lit(None).cast("string"))) == ["-A--", "+12,5%", "'=1+1", None]


@pytest.mark.parametrize(
    ("text", "kind", "roles", "headers", "route"),
    [
        ("It shall show records through class 7, attribute 2.", "clause", [], [], "mixed"),
        ("It shall log.", "clause", [], [], "b_track"),
        ("装置必须记录。", "clause", [], [], "b_track"),
        ("Read-only access, attribute 2", "clause", [], [], "review"),
        ("Log | 1-1:0.99.98.255", "table_row", ["cosem_structured"], ["CL"], "a_track"),
        ("It shall go on", "heading", [], [], "context"),
        ("plain words", "narrative", [], [], "context"),
    ],
)
def test_routes(spark, text, kind, roles, headers, route):
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert one(spark, routing.unit_route(F.lit(text), F.lit(kind), strings(roles), strings(headers), F.lit(""))["route"]) == [route]


def test_tender_words(spark):
    got = one(spark, *(tender.region_of_heading(F.lit(x)) for x in ("Qualification tests", "Qualification criteria", "Agreement", "FOREWORD!", "Something", "")))
    assert got == ["tender_technical", "tender_instructions", "tender_commercial", "tender_preface", None, None]


def test_tables_of_nothing_and_one_cell(spark):
    empty = spark.createDataFrame([], "t int, r int, c int, text string")
    ranges = spark.createDataFrame([], "t int, r1 int, c1 int, r2 int, c2 int")
    found = tables.facts(empty, ["t"])
    tabs, rows = tables.structure(found, tables.rows_of(found, ranges, ["t"]), ["t"])
    assert tabs.count() == 0 and rows.count() == 0
    single = spark.createDataFrame([(1, 1, 1, "It shall go"), (2, 1, 1, None), (3, 1, 1, "Name")], "t int, r int, c int, text string")
    found = tables.facts(single, ["t"])
    tabs, _ = tables.structure(found, tables.rows_of(found, ranges, ["t"]), ["t"])
    assert {r.t: (r.header_rows, r.status) for r in tabs.collect()} == {1: ([], "ambiguous"), 2: ([1], "inferred"), 3: ([1], "ambiguous")}


def test_explicit_headers_win(spark):
    cells = spark.createDataFrame([(1, r, c, f"v{r}{c}") for r in (1, 2, 3) for c in (1, 2)] + [(2, r, c, f"v{r}{c}") for r in (1, 2) for c in (1, 2)], "t int, r int, c int, text string")
    ranges = spark.createDataFrame([], "t int, r1 int, c1 int, r2 int, c2 int")
    told = spark.createDataFrame([(1, [1, 2]), (2, [])], "t int, header_rows array<int>")
    found = tables.facts(cells, ["t"])
    tabs, rows = tables.structure(found, tables.rows_of(found, ranges, ["t"]), ["t"], told)
    assert {r.t: (r.header_rows, r.status, r.evidence) for r in tabs.collect()} == {1: ([1, 2], "explicit", ["explicit_header_rows:1,2"]), 2: ([], "explicit", ["explicit_header_rows:headerless"])}
    heads = {(r.t, r.c): r.header for r in tables.headers(found, rows, tabs, ["t"]).collect()}
    assert heads == {(1, 1): "v11 v21", (1, 2): "v12 v22", (2, 1): "column_1", (2, 2): "column_2"}


def test_states_and_chains_of_nothing(spark):
    none = spark.createDataFrame([], "k int, o int, s string")
    assert ledgers.states(none, "k", "o", "s").count() == 0
    some = spark.createDataFrame([(1, 1, "rejected"), (1, 2, "accepted"), (2, 1, "frozen")], "k int, o int, s string")
    assert {r.k: (r.status, r.steps, r.refused) for r in ledgers.states(some, "k", "o", "s").collect()} == {1: ("rejected", 1, 1), 2: ("candidate", 0, 1)}


def test_attributes_without_objects(spark):
    attrs = spark.createDataFrame([(1, 1, 1, "Clock", "time", "T-1", 2), (1, 2, 2, None, None, None, None)], "doc int, aid int, ord int, parent string, attr string, tbl string, row int")
    none = spark.createDataFrame([], "doc int, oid string, ord int, name string, class_id string, tbl string, row int")
    assert objects.parents(attrs, none, ["doc"]).count() == 0
