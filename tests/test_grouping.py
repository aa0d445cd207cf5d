"""Groups against a plain gather, and experts' decisions on nulls, ties and empty tables."""

import random

from pyspark.sql import functions as F

from clausework.functions import rules
from clausework.operators import grouping


def gathered(nodes, edges):
    """Nodes in order; each that is left takes all it reaches among those left."""
    out = {}
    for seed in sorted(nodes):
        if seed in out:
            continue
        out[seed], todo = seed, [seed]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b in nodes and b not in out:
                    out[b] = seed
                    todo.append(b)
    return out


def test_reach_groups_like_a_gather(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(200), 120)
    edges = [(rng.choice(nodes), rng.randrange(200)) for _ in range(90)]
    chain = list(range(1000, 1060))
    nodes += chain
    edges += [(b, a) if b % 7 == 0 else (a, b) for a, b in zip(chain, chain[1:])]
    made = spark.createDataFrame([(n,) for n in [*nodes, nodes[0], None]], "id long")
    got = grouping.reach_groups(made, spark.createDataFrame([*edges, edges[0], (None, 1)], "from long, to long"))
    assert {r.id: r.group for r in got.collect()} == gathered(set(nodes), edges)
    assert got.count() == len(set(nodes))
    assert grouping.reach_groups(made.limit(0), spark.createDataFrame([], "from long, to long")).count() == 0


def test_explicit_groups_fall_apart(spark):
    rows = [(1, "Valve Key", "", "local use"), (2, "valve key", "", "remote use"), (3, "Meter", "", "local"), (4, "meter", "", None), (5, "Event", "a", ""), (6, "event", "b", ""), (7, "event management", "a", ""), (8, "event management", None, ""), (9, None, "", ""), (10, " ", "", "")]
    df = spark.createDataFrame(rows, "id int, key string, subject string, text string")
    got = {r.id: (r.group, r.method) for r in grouping.explicit_groups(df, rules.qualifier_sides(F.col("text"))).collect()}
    assert got == {1: (1, "singleton"), 2: (2, "singleton"), 3: (3, "explicit_key"), 4: (3, "explicit_key"), 5: (5, "singleton"), 6: (6, "singleton"), 7: (7, "explicit_key"), 8: (7, "explicit_key")}
    assert grouping.explicit_groups(df.limit(0), []).count() == 0


def test_conflicting_values_split_a_group(spark):
    rows = [(1, 1, "legacy_concept", [("v", "1"), ("v", "2")]), (2, 1, "legacy_concept", [("v", "2"), ("v", "1")]), (3, 3, "event_subject", [("v", "1")]), (4, 3, "event_subject", [("v", "2"), ("h", "9")]),
            (5, 5, "period_variant", [("v", "1")]), (6, 5, "period_variant", [("v", "2")]), (7, 7, "explicit_key", [("v", "1")]), (8, 7, "explicit_key", [("v", "2")]), (9, 9, None, None)]
    df = spark.createDataFrame(rows, "id int, group int, method string, constraints array<struct<unit string, value string>>")
    assert sorted((r.group, r.unit, tuple(r["values"])) for r in grouping.unit_conflicts(df).collect()) == [(3, "v", ("1", "2")), (7, "v", ("1", "2"))]
    got = {r.id: (r.group, r.method) for r in grouping.split_conflicts(df).collect()}
    assert got == {1: (1, "legacy_concept"), 2: (1, "legacy_concept"), 3: (3, "singleton"), 4: (4, "singleton"), 5: (5, "period_variant"), 6: (5, "period_variant"), 7: (7, "explicit_key"), 8: (7, "explicit_key"), 9: (9, "singleton")}


def test_replayed_edges_and_insights(spark):
    e = spark.createDataFrame([(1, "a", "accept", "x"), (2, "a", " Reject", None), (3, "a", "perhaps", "y"), (4, None, "accept", "z"), (5, "b", "ACCEPT", "w"), (6, "b", None, "w")], "i int, edge_id string, decision string, kind string")
    assert sorted(tuple(r) for r in grouping.replayed_edges(e, "i", ["kind"]).collect()) == [("a", "reject", ""), ("b", "accept", "w")]
    assert [tuple(r) for r in grouping.replay_counts(e, "i").collect()] == [(6, 3, 1, 1)]
    assert [tuple(r) for r in grouping.replay_counts(e.limit(0), "i").collect()] == [(0, 0, 0, 0)]
    s = spark.createDataFrame([(i, "B" if i < 4 else None, None, "rejected" if i > 2 else None) for i in range(1, 6)], "id int, module_override string, owner_override string, status string")
    t = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "A", None), (4, None, "x")], "id int, module string, owner string")
    got = sorted(tuple(r) for r in grouping.decision_insights(s, t).collect())
    assert got == [("module", "A", "B", 3, True), ("rejected", "(未分模块)", "", 1, False), ("rejected", "A", "", 1, False)]
