"""Ids that are null, repeated or text, columns named like internal ones, empty tables, repeated rows and long texts."""

import random

import pytest

CLASH = "doc_id long, text string, source string, n_chars long, _id string, _d string, _k string, _new string, _gone string, _bad string, _text string, _row string, row string, id string, tid long, n_tokens string, ids_sha256 string, c0 string"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, "h", len(t or ""), *"abcdefghij", 7, "x", "y", "z") for i, t in rows], CLASH)


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_near_duplicates_keep_null_and_repeated_ids(spark):
    from clausework.llm.ngram_join import one_of_each_group

    near = prose(1).split()
    near[3] = "other"
    rows = [(None, prose(2)), (None, prose(3)), (5, prose(4)), (5, prose(5)), (6, prose(1, 400)), (7, prose(1, 400) + " more"), (6, prose(1, 400)), (8, None), (8, None), (9, " \n"), (10, ""), (None, prose(5))]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in one_of_each_group(clash(spark, rows)).collect())
    want = [(None, prose(2)), (None, prose(3)), (5, prose(4)), (5, prose(5)), (6, prose(1, 400)), (8, None), (8, None), (9, " \n"), (10, "")]
    assert got == sorted((i is None, i or 0, t or "") for i, t in want)
    out = one_of_each_group(clash(spark, rows))
    assert out.columns == clash(spark, rows).columns and out.schema == clash(spark, rows).schema
    assert one_of_each_group(clash(spark, rows[:0])).count() == 0


def test_text_ids(spark):
    from clausework.llm.ngram_join import jaccard_components

    df = spark.createDataFrame([("b", prose(1)), ("a", prose(1)), ("c", prose(2)), (None, prose(2))], "doc_id string, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {("b", "a"), ("a", "a"), ("c", "c"), (None, "c")}


def test_repeated_id_is_judged_by_its_own_text(spark):
    from clausework.llm.ngram_join import jaccard_components

    df = spark.createDataFrame([(1, prose(1)), (1, prose(2)), (2, prose(1) + " x"), (3, prose(2) + " x"), (4, prose(3))], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 56, 4)]
    assert len({r.group_id for r in jaccard_components(df).collect()}) == 3


def test_stages_take_any_column_names(spark):
    import corpus_pipeline as cp

    boiler = "\nread all about it here 5"
    rows = [(i, prose(i) + boiler) for i in range(30)] + [(None, prose(99)), (40, prose(40)), (40, prose(41)), (50, None)]
    df = clash(spark, rows)
    kept = cp.quality(spark, df, "/root/testdata/sf0.001")
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {t.replace(boiler, "") for _, t in rows if t}
    assert all(r.n_chars == len(r.text) and r._new == "d" and r.tid == 7 for r in kept.collect())
    for stage in (cp.near_duplicates, cp.decontamination, cp.personal_data):
        assert stage(spark, df, "/root/testdata/sf0.001").columns == df.columns
        assert stage(spark, df, "/root/testdata/sf0.001").count() == len(rows)
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0
    last = cp.tokens(spark, df, "/root/testdata/sf0.001")
    assert last.count() == len(rows) and {"n_tokens", "n_tokens_", "ids_sha256_", "round_trip"} <= set(last.columns)
    assert all(r.n_tokens_ == "x" and r.c0 == "z" for r in last.collect())


def test_decontamination_of_null_ids_and_repeated_items(spark):
    from clausework.llm.decontaminate import contaminated, decontaminated

    items = spark.createDataFrame([(1, prose(1, 30)), (1, prose(2, 30)), (2, prose(2, 30)), (3, None)], "item_id long, text string")
    rows = [(None, "x y " + prose(1, 30)), (7, prose(2, 30) + " z"), (7, prose(3)), (None, prose(4)), (7, prose(2, 30) + " z")]
    got = {(r.doc_id, r.item_id, r.start, r.similarity) for r in contaminated(clash(spark, rows), items).collect()}
    assert got == {(None, 1, 2, 1.0), (7, 1, 0, 1.0), (7, 2, 0, 1.0)}
    assert sorted(r.text for r in decontaminated(clash(spark, rows), items).collect()) == sorted([prose(3), prose(4)])
    assert decontaminated(clash(spark, rows), items.limit(0)).count() == 5 and contaminated(clash(spark, rows[:0]), items).count() == 0


def test_decontamination_recall_on_edited_passages(spark):
    """Windows of edited copies on both sides of the threshold, and far ones, against brute force over every window."""
    from clausework.llm.decontaminate import K, contaminated

    rnd = random.Random(8)
    items = {i: prose(100 + i, rnd.randrange(30, 90)).split() for i in range(6)}
    rows = {}
    for d in range(60):
        x = list(items[d % 6])
        for _ in range(rnd.randrange(0, 4)):
            x[rnd.randrange(len(x))] = f"new{d}"
        rows[d] = prose(1000 + d, rnd.randrange(5, 40)).split() + x + prose(2000 + d, 9).split()
    grams = lambda ws: {tuple(ws[j : j + K]) for j in range(len(ws) - K + 1)}
    want, clean = set(), 0
    for d, ws in rows.items():
        for i, x in items.items():
            a, best = grams(x), 0
            for s in range(len(ws) - len(x) + 1):
                b = grams(ws[s : s + len(x)])
                best = max(best, len(a & b) / len(a | b))
            if best >= 0.8:
                want.add((d, i))
            else:
                clean += 1
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 15 and clean > 300


@pytest.mark.parametrize("text", ["x" * 200_000, "word " * 60_000, "\n" * 100_000, "1" * 100_000])
def test_long_texts_go_through_whole(spark, text):
    import corpus_pipeline as cp

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for stage in (cp.near_duplicates, cp.personal_data):
        assert stage(spark, df, "/root/testdata/sf0.001").first().text == text
    r = cp.tokens(spark, df, "/root/testdata/sf0.001").first()
    assert r.round_trip and r.n_tokens > 1000


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40, 33_000])
def test_simhash_by_brute_force(spark, n):
    from clausework.llm.decontaminate import simhash

    rnd = random.Random(n)
    hs = [rnd.getrandbits(64) - (1 << 63) for _ in range(n)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)
    got = spark.createDataFrame([(hs,)], "h array<long>").select(simhash("h").alias("s")).first().s
    assert got % (1 << 64) == want
