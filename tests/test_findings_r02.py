"""Cases of the second round's findings."""

import duckdb
from pyspark.sql import functions as F

from clausework.operators import ledgers, tables
from clausework.plans import ledger_queries


def test_matrix_signals_without_rows(spark, tmp_path):
    """a customer whose orders have no lines is not in the SQL."""
    spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,)] * 8 + [(2,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ledger_queries.ORACLE["matrix_signals"]).fetchall()
    assert [tuple(r) for r in ledger_queries.QUERIES["matrix_signals"](spark, str(tmp_path)).collect()] == want == [(10, 9, True)]


def test_exemplars_of_copies(spark):
    """copies are ranked once; 30,000 questions by 30,000 examples of one text would be 1.8 billion meetings."""
    text = F.lit("hot bolt")
    q = spark.range(30_000).select(F.col("id").alias("qid"), F.lit("m").alias("module"), text.alias("text"))
    e = spark.range(30_000).select("id", F.lit("m").alias("module"), F.when(F.col("id") < 3, "hot ring").otherwise(text).alias("text"), F.lit(700).alias("size"))
    out = ledgers.exemplars(q, e)
    assert [tuple(r) for r in out.groupBy("id", "score").count().collect()] == [(3, 2, 30_000)]
    assert {(r.id, r.score) for r in ledgers.exemplars(q.limit(1), e.withColumn("size", F.lit(600))).collect()} == {(3, 2), (4, 2)}
    assert ledgers.exemplars(q.limit(1).withColumn("module", F.lit(None).cast("string")), e).count() == 0


def test_range_conflicts_by_one_join(spark):
    """texts of a range are brought by one join; blank or equal texts are no conflict, one beside a blank first cell is."""
    cells = [(1, 1, 1, "a"), (1, 1, 2, " a "), (1, 2, 1, ""), (1, 3, 1, None), (1, 3, 2, "x"), (1, 5, 1, "a"), (1, 5, 2, "a"), (1, 5, 3, "b")]
    ranges = [(1, 1, 1, 2, 2), (1, 3, 1, 3, 2), (1, 5, 1, 5, 3), (1, 9, 9, 9, 10), (1, 4, 2, 4, 1)]
    out = tables.range_conflicts(spark.createDataFrame(cells, "t long, r int, c int, text string"), spark.createDataFrame(ranges, "t long, r1 int, c1 int, r2 int, c2 int"), ["t"])
    assert {(r.r1, r.conflict) for r in out.collect()} == {(1, False), (3, True), (5, True), (9, False)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_example_words_are_counted_over_all_texts(spark):
    """word j stands in 1,000 - j texts, so the 200 commonest are known; later words sort first, so a sample's ties would take them."""
    from clausework.llm.secret_scan import examples

    name = lambda j: "w" + "".join(chr(97 + x) for x in divmod(675 - j, 26))
    texts = [(i, " ".join(name(j) for j in range(400) if i < 1000 - j)) for i in range(1500)]
    docs = spark.createDataFrame(texts + texts[700:800] * 3, "doc_id long, text string")
    used = {x for r in examples(docs, rows=4000).select(F.split("text", " ").alias("w")).collect() for x in (r.w[0], r.w[1], r.w[-1]) if len(x) == 3 and x[0] == "w"}
    assert used and used <= {name(j) for j in range(200)}
