"""Workbooks and documents read back by the scans; names, odd characters, limits, empty tables."""

import pytest

from clausework.sources import office, office_sinks


def test_workbooks_come_back(spark, tmp_path):
    rows = [("a.xlsx", "One", 2, ["007", None, "=1+1"]), ("a.xlsx", "One", 1, ["id", "", "x & <y>\x01"]), ("a.xlsx", None, 1, [" b ", "line\nfeed\rback"]), ("deep/b.xlsx", "a/b", 1, ["z"]), ("deep/b.xlsx", "a?b", 1, None)]
    df = spark.createDataFrame(rows, "path string, sheet string, ord int, cells array<string>")
    sizes = office_sinks.stored(office_sinks.workbooks(df), "file://" + str(tmp_path / "out"))
    assert sorted(r.path for r in sizes.collect()) == ["a.xlsx", "deep/b.xlsx"] and not list(tmp_path.rglob("*.part"))
    got = {}
    for name in ("a.xlsx", "deep/b.xlsx"):
        data = (tmp_path / "out" / name).read_bytes()
        got |= {(name, x[0], x[2], x[3]): x[7] for x in office.xlsx_items(data)}
    assert got == {("a.xlsx", "One", 1, 1): "id", ("a.xlsx", "One", 1, 3): "x & <y>", ("a.xlsx", "One", 2, 1): "007", ("a.xlsx", "One", 2, 3): "=1+1", ("a.xlsx", "Sheet", 1, 1): " b ", ("a.xlsx", "Sheet", 1, 2): "line\nfeed\rback", ("deep/b.xlsx", "a_b", 1, 1): "z"}
    assert office_sinks.workbooks(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="not a path below"):
        office_sinks.stored(spark.createDataFrame([("../x", b"1")], "path string, content binary"), str(tmp_path))


def test_names_and_limits(spark, monkeypatch):
    assert [office_sinks.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert office_sinks.sheet_names(["a" * 40, "A" * 40, None, "sheet", "[x]"]) == ["a" * 31, "A" * 29 + "_2", "Sheet", "sheet_2", "_x_"]
    monkeypatch.setattr(office_sinks, "SHEET_ROWS", 1)
    with pytest.raises(ValueError, match="beyond"):
        office_sinks.workbooks(spark.createDataFrame([("a", "s", 1, ["x"]), ("a", "s", 2, ["y"])], "path string, sheet string, ord int, cells array<string>"))


def test_documents_come_back(spark):
    rows = [("d", 2, "table", None, None, [["a", None, "c"], ["<b>"]]), ("d", 1, "paragraph", "heading 1", "Scope & aim", None), ("d", 3, "paragraph", None, "one\ntwo", None), ("e", 1, "paragraph", "", None, None)]
    df = spark.createDataFrame(rows, "path string, ord int, kind string, style string, text string, rows array<array<string>>")
    made = office_sinks.documents(df)
    got = sorted((r.path, r.ord, r.kind, r.style, r.text, r.rows) for r in office.docx(made).collect())
    assert got == [("d", 1, "paragraph", "heading 1", "Scope & aim", []), ("d", 2, "table", None, None, [["a", "", "c"], ["<b>", "", ""]]), ("d", 3, "paragraph", "", "one\ntwo", []), ("e", 1, "paragraph", "", "", [])]
    assert {r.path: bytes(r.content) for r in made.collect()} == {r.path: bytes(r.content) for r in office_sinks.documents(df).collect()}
