"""Fixtures for expressions and operators that SQL does not state."""

from pyspark.sql import functions as F

from clausework.functions import rules, scalars
from clausework.operators import outline


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.clean(lit("“a”  – b…")), scalars.clean(lit(None).cast("string"))) == ['"a" - b...', ""]
    assert one(spark, scalars.truncated(lit("abcdefgh"), 6), scalars.truncated(lit("abc"), 6)) == ["abc...", "abc"]
    assert one(spark, scalars.joined_digits(lit("4 000 and 4,000 and 40 00"))) == ["4000 and 4000 and 40 00"]
    assert one(spark, scalars.without_references(lit("see Clause 7 and 7.4.1 at 10.5 m"))) == ["see   and   at 10.5 m"]
    assert one(spark, scalars.without_enumerators(lit("1) first\n2. second 3.5"))) == ["  first\n  second 3.5"]
    assert one(spark, scalars.codes(lit("use 0-0:41.0.0.255. and 0x1F"))) == [["0-0:41.0.0.255", "0x1F"]]
    assert one(spark, scalars.drift(lit("12 of 0x2A"), lit("12 of 0x2B"))) == [["0x2A"]]
    assert one(spark, scalars.gram_jaccard(lit("abcdefg"), lit("abcdefg")), scalars.gram_jaccard(lit("ab"), lit("ab")), scalars.gram_jaccard(lit(""), lit(""))) == [1.0, 1.0, 0.0]
    assert one(spark, scalars.column_letter(lit(1)), scalars.column_letter(lit(27)), scalars.column_letter(lit(703)), scalars.column_letter(lit(0))) == ["A", "AA", "AAA", "A"]
    assert one(spark, scalars.access_map(lit("R/W/-/RW")), scalars.access_map(lit("R/W"))) == [{"RC": "R", "PC": "W", "SC": "-", "LC": "RW"}, {}]
    assert one(spark, scalars.padded(F.array(lit("a")), 3), scalars.slug(lit('a/b:  "c"')), scalars.slug(lit(" "))) == [["a", "", ""], "a b c", "untitled"]
    assert one(spark, scalars.float_or(lit("x"), 0.5), scalars.float_or(lit("2"), 0.5)) == [0.5, 2.0]
    assert one(spark, scalars.header_set(F.array(lit("Req_ID/Name")))) == [["name", "req id", "req id/name"]]


def test_rules(spark):
    lit = F.lit
    assert one(spark, rules.heading_level(lit("4.1 General rules")), rules.heading_level(lit("100 litres of water")), rules.heading_level(lit("5 Scope 12"))) == [2, None, None]
    assert one(spark, rules.section_adjacent(lit("4.1.2"), lit("4.1.3")), rules.section_adjacent(lit("4.1.2"), lit("4.1.4")), rules.section_adjacent(lit(""), lit(""))) == [True, False, False]
    assert one(spark, rules.opposed(lit("local use"), lit("remote use")), rules.opposed(lit("local"), lit("local"))) == [True, False]
    assert one(spark, rules.lifecycle(lit(True), lit("done"), lit(False)), rules.lifecycle(lit(False), lit(""), lit(False), lit("verified"))) == ["implemented", "verified"]
    assert one(spark, rules.priority(lit("accept"), lit("bad")), rules.priority(lit("accept"), lit("0.5")), rules.status_of(lit("accept"))) == ["P1", "P2", "confirmed"]


def test_packing_follows_each_rule(spark):
    rows = [(1, i, n, k, s) for i, (n, k, s) in enumerate([(40, "paragraph", "a"), (10, "heading", "a"), (30, "paragraph", "a"), (20, "paragraph", "b"), (10, "table", "b"), (90, "paragraph", "b"), (20, "paragraph", "b")])]
    df = spark.createDataFrame(rows, "d long, o int, n long, k string, s string")
    got = outline.packed(df, "d", "o", "n", "k", "s", 100).orderBy("o").select("chunk").collect()
    assert [r.chunk for r in got] == [1, 2, 2, 2, 3, 4, 5]


def test_merged_ranges_fill_from_the_anchor(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, ""), (1, 2, 1, None), (1, 2, 2, "own")], "t int, row int, col int, text string")
    ranges = spark.createDataFrame([(1, 1, 1, 2, 2)], "t int, r1 int, c1 int, r2 int, c2 int")
    got = {(r.row, r.col): r.text for r in outline.merged_fill(cells, ranges, ["t"]).collect()}
    assert got == {(1, 1): "a", (1, 2): "a", (2, 1): "a", (2, 2): "own"}


def test_sections_gather_wherever_they_stand(spark):
    df = spark.createDataFrame([("A", 1, "x", "b1"), ("B", 2, "y", "b2"), ("A", 3, "z", "b3")], "p string, o int, t string, i string")
    got = {r.p: (r["first"], r.text, r.ids) for r in outline.sections(df, ["p"], "o", "t", "i").collect()}
    assert got == {"A": (1, "x\nz", ["b1", "b3"]), "B": (2, "y", ["b2"])}


def test_column_letter_has_no_bound(spark):
    def letters(n):
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out or "A"

    ns = [-1, 0, 1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert {r.n: r.x for r in df.select("n", scalars.column_letter(df.n).alias("x")).collect()} == {n: letters(n) for n in ns}
