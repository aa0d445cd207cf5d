"""Operators on nulls, ties, empty tables; the streaming fold; sinks."""

from pyspark.sql import functions as F

from clausework.operators import joins, windows
from clausework.sources import files
from clausework.streaming import fold


def test_as_of_ties_nulls_and_empty(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 5, 10), (1, 2, 20), (None, 4, 30)], "k int, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.as_of(a, b, "k", "t", "v").collect()}
    assert got == {(1, 5): 10, (1, 1): None, (2, 9): None, (None, 5): None}
    got = {(r.k, r.t): r.v for r in joins.as_of(a, b, "k", "t", "v", forward=True).collect()}
    assert got == {(1, 5): 10, (1, 1): 20, (2, 9): None, (None, 5): None}
    assert joins.as_of(a.limit(0), b, "k", "t", "v").count() == 0


def test_budget_keeps_the_first(spark):
    df = spark.createDataFrame([("x", 1, 500), ("x", 2, 1), ("y", 1, 3), ("y", 2, 4), ("y", 3, 9)], "g string, i int, c int")
    got = sorted((r.g, r.i) for r in windows.within_budget(df, "c", 7, ["g"], [F.asc("i")]).collect())
    assert got == [("x", 1), ("y", 1), ("y", 2)]


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2, "z": 0}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert sorted((r.a is None, r._bad is None) for r in rows) == [(False, True), (False, True), (True, False)]
    files.write_csv(spark.createDataFrame([("=1+1", "-5")], "x string, y string"), str(tmp_path / "csv"))
    assert "'=1+1,-5" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


def test_strict_and_torn_jsonl(spark, tmp_path):
    import pytest

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_bytes("\ufeff{\"a\": 1}\n\n{\"a\": 2}\r\n{\"a\": 3".encode())
    (tmp_path / "t" / "b.jsonl").write_text('{"a": 5}\n')
    assert sorted(r.a for r in files.recover_torn_tail(spark, str(tmp_path / "t"), "a int").collect()) == [1, 2, 5]
    (tmp_path / "u.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="broken line"):
        files.recover_torn_tail(spark, str(tmp_path / "u.jsonl"), "a int").collect()
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "u.jsonl"), "a int", strict=True).collect()


def test_html_blocks_and_tables():
    html = "<html><head><title>t</title><script>var p = '<p>'</script></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b></p><h2></h2><h2>C</h2><table><tr><th>x</th><td>1</td></tr><tr><td> </td></tr><tr><td>2</td></tr></table><h1>D</h1><p> </p><p>end</p>"
    assert files.blocks_of(html) == [
        (1, "heading", 1, "A & B", ["A & B"], []),
        (2, "paragraph", None, "one", ["A & B"], []),
        (3, "paragraph", None, "two bold", ["A & B"], []),
        (4, "heading", 2, "C", ["A & B", "C"], []),
        (5, "table", None, "HTML table", ["A & B", "C"], [["1", "x"], ["2", ""]]),
        (6, "heading", 1, "D", ["D"], []),
        (7, "paragraph", None, "end", ["D"], []),
    ]
    assert files.blocks_of(None) == [] and files.blocks_of("plain") == []


def test_table_cells_of_html(spark):
    page = spark.createDataFrame([(1, "<table><tr><td>a</td><td> b  c </td></tr></table>"), (2, None)], "id long, html string")
    assert [tuple(r) for r in files.cells_of(files.html_blocks(page, "id", "html")).orderBy("c").collect()] == [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b c")]


def test_stream_fold(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string").write.parquet(src)
    q = fold.latest(spark.readStream.schema("k string, o int, v string").parquet(src), "k", "o", "v").writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.v) for r in spark.table("folded").collect()} == {("a", "y"), ("b", "z")}
