"""Components against brute force over all pairs."""

import random
import re

from clausework.llm.ngram_join import connected, jaccard_components

SCHEMA = "doc_id long, text string, n long, sig long, col string"


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[ws[j:] for j in range(k)])) if len(ws) >= k else ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    base = [word() for _ in range(60)]
    out = [(1000, None), (7, ""), (8, " \t\n"), (9, "One two"), (10, "one  TWO"), (11, "one two three"), (12, "x" * 5000)]
    for i in range(60):  # a group of near copies at graded distances, and unrelated texts with a shared passage
        ws = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            ws[rnd.randrange(60)] = word()
        out.append((100 + i, " ".join(ws)))
        out.append((300 + i, " ".join([word() for _ in range(30)] + base[:20])))
    return out


def test_components_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, 4, 85, 100).collect()}
    assert got == brute(data, 4, 85, 100)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f", 0, 0, ""), (3, "a b c d e f", 0, 0, ""), (2, "A b c d e f", 0, 0, "")], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(2, 2), (3, 2), (3, 2)]


def test_connected_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "a long, b long")
    got = {r.node: r.comp for r in connected(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}
