"""Groups of rows that state one function, and what experts' decisions say of them.

Nulls: a null key, method or text counts as empty; a null id or edge end is left out. Empty tables give empty results. Ids break every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions import scalars
from clausework.operators.ledgers import merged_equivalents
from clausework.sources.store import written

# fixed values
EVENT_KEYS = ("事件", "事件管理", "事件处理", "event", "eventmanagement")
VARIANT_METHODS = ("protocol_profile_variant", "period_variant")
FEATURED_METHODS = ("event_subject", "protocol_profile_variant", "period_variant", "explicit_semantic")
SUGGESTED_FROM = 3
NO_MODULE = "(未分模块)"


def _v(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def reach_groups(nodes: DataFrame, edges: DataFrame, key: str = "id", limit: int = 100) -> DataFrame:
    """key, group: the smallest node that a path of (from, to) edges leads from, itself included.

    That is what taking nodes in order and letting each gather all that it reaches comes to, for a node that an earlier one has
    taken leads nowhere that the earlier one does not. Each round passes labels along edges and on to the label's own label, so the rounds grow
    with the logarithm of the longest path where labels meet; they are written to the shared folder. RuntimeError beyond `limit` rounds.
    """
    known = nodes.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
    pairs = edges.select("from", "to").where("`from` <> `to`").distinct()
    pairs = pairs.join(known.select(F.col("id").alias("from")), "from").join(known.select(F.col("id").alias("to")), "to")
    pairs, now = written(pairs, "edges"), written(known.withColumn("group", F.col("id")), "labels")
    for _ in range(limit):
        label = now.select(F.col("id").alias("from"), "group")
        passed = pairs.join(label, "from").select(F.col("to").alias("id"), "group")
        further = now.where("id <> group").select("id", F.col("group").alias("from")).join(label, "from").select("id", "group")
        least = passed.unionByName(further).groupBy("id").agg(F.min("group").alias("_g"))
        after = now.join(least, "id", "left").select("id", F.least("group", F.coalesce("_g", "group")).alias("group"), (F.coalesce("_g", "group") < F.col("group")).alias("moved"))
        after = written(after, "labels")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now.withColumnRenamed("id", key)
    raise RuntimeError("labels still move")


def explicit_groups(rows: DataFrame, opposed: list[tuple[Column, Column]]) -> DataFrame:
    """id, group, method of rows (id, key, subject) with a key: the least id of equal normal keys.

    A key falls apart into single rows where one row holds the left side of a pair of opposed qualifiers and another the right side
    alone, or where a bare event key spans several subjects. Both are found by counting, with no pair of rows formed.
    """
    sides = [(F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))) for a, b in opposed]
    keyed = rows.select("id", scalars.key_of(_v("key")).alias("key"), _v("subject").alias("subject"), *(c for i, (a, b) in enumerate(sides) for c in (a.alias(f"_a{i}"), (b & ~a).alias(f"_b{i}")))).where("key <> '' AND id IS NOT NULL")
    named = F.nullif(F.col("subject"), F.lit(""))
    split = F.lit(False)
    for i in range(len(sides)):
        split = split | (F.bool_or(f"_a{i}") & F.bool_or(f"_b{i}"))
    split = split | (F.col("key").isin(*EVENT_KEYS) & (F.min(named) < F.max(named)))
    found = keyed.groupBy("key").agg(F.min("id").alias("_g"), F.coalesce(split, F.lit(False)).alias("_split"))
    out = keyed.select("id", "key").join(found, "key")
    return out.select("id", F.when(F.col("_split"), F.col("id")).otherwise(F.col("_g")).alias("group"), F.when(F.col("_split"), "singleton").otherwise("explicit_key").alias("method"))


def unit_conflicts(rows: DataFrame) -> DataFrame:
    """group, unit, values of rows (id, group, method, constraints: array of (unit, value)): units whose rows state different sets of values.

    Methods whose rows are variants are exempt; rows that repeat an id count as one row. Values are those of all rows of the group, sorted.
    """
    met = rows.where(~_v("method").isin(*VARIANT_METHODS)).select("id", "group", F.explode("constraints").alias("c"))
    sets = met.groupBy("group", "id", F.col("c.unit").alias("unit")).agg(F.sort_array(F.collect_set("c.value")).alias("v"))
    kinds = sets.groupBy("group", "unit", "v").agg(F.count("*").alias("n"))  # equal sets meet before the group does
    found = kinds.groupBy("group", "unit").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("values"))
    return found.where("n > 1").select("group", "unit", "values")


def split_conflicts(rows: DataFrame) -> DataFrame:
    """id, group, method: rows of a group with conflicting values stand alone, but for groups of one explicit key; so does the row of a group of one."""
    rows = rows.select("id", "group", _v("method").alias("method"), "constraints")
    bad = unit_conflicts(rows.where("method <> 'explicit_key'")).select("group").distinct().withColumn("_bad", F.lit(True))
    size = rows.groupBy("group").agg(F.count("*").alias("_n"))
    out = rows.join(size, "group").join(bad, "group", "left")
    alone = F.col("_bad").isNotNull()
    method = F.when(alone | ((F.col("_n") == 1) & (F.col("method") != "explicit_key")), "singleton").otherwise(F.col("method"))
    return out.select("id", F.when(alone, F.col("id")).otherwise(F.col("group")).alias("group"), method.alias("method"))


def merged_functions(rows: DataFrame, lists: list[str]) -> DataFrame:
    """One row a group: rows, its lists joined in order of ord without repeats or empties, method, confidence and an id made of source_ids.

    source_ids must be among the lists. The confidence is 1 for an explicit key or a row alone, 0.9 for a group by a named feature, else 0.75.
    """
    key = ["group", "method"]
    out = merged_equivalents(rows, key, "ord", lists).join(rows.groupBy(*key).agg(F.count("*").alias("rows")), key)
    out = out.select(*key, "rows", *(F.filter(c, lambda x: x.isNotNull() & (x != "")).alias(c) for c in lists))
    name = F.concat(F.lit("FREQ-"), F.substring(F.sha1(F.array_join("source_ids", "\x1f")), 1, 12))
    sure = F.when(F.col("method") == "explicit_key", 1.0).when(F.col("method").isin(*FEATURED_METHODS), 0.9).when(F.col("rows") > 1, 0.75).otherwise(1.0)
    return out.withColumn("function_id", name).withColumn("confidence", sure)


# --- experts' decisions


def _is_edge_event() -> Column:
    return (_v("edge_id") != "") & F.lower(F.trim(_v("decision"))).isin("accept", "reject")


def replayed_edges(events: DataFrame, order: str, body: list[str]) -> DataFrame:
    """edge_id, decision and body of the last valid event of each edge; events without an edge or a known decision are skipped."""
    last = F.max_by(F.struct(F.lower(F.trim("decision")).alias("decision"), *(_v(c).alias(c) for c in body)), order).alias("_e")
    return events.where(_is_edge_event()).groupBy("edge_id").agg(last).select("edge_id", "_e.*")


def replay_counts(events: DataFrame, order: str) -> DataFrame:
    """One row: events, skipped, accepted, rejected."""
    edge = F.when(_is_edge_event(), F.col("edge_id"))  # skipped events meet under a null edge
    last = F.max_by(F.lower(F.trim("decision")), order)
    per = events.groupBy(edge.alias("edge")).agg(F.count("*").alias("n"), last.alias("decision"))
    known = F.col("edge").isNotNull()
    counts = [F.sum(F.when(~known, F.col("n")).otherwise(0)), F.count_if(known & (F.col("decision") == "accept")), F.count_if(known & (F.col("decision") == "reject"))]
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts, ("skipped", "accepted", "rejected"), strict=True)))


def decision_insights(states: DataFrame, items: DataFrame) -> DataFrame:
    """kind, from, to, n, suggested: what experts changed in decided items that still exist.

    states: id, module_override, owner_override, status; items: id, module, owner (the rules' verdict). Kinds: module and owner count changes from a value
    that was stated to another one, rejected counts by module. A change made SUGGESTED_FROM times or more is suggested as a rule.
    """
    both = states.select("id", *(F.trim(_v(c)).alias(c) for c in ("module_override", "owner_override", "status"))).join(items.select("id", F.trim(_v("module")).alias("module"), F.trim(_v("owner")).alias("owner")), "id")

    def entry(kind: str, a: Column, b: Column, wanted: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(kind).alias("kind"), a.alias("from"), b.alias("to")))

    changed = lambda a, b: (F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b))
    entries = F.array(
        entry("module", F.col("module"), F.col("module_override"), changed("module", "module_override")),
        entry("owner", F.col("owner"), F.col("owner_override"), changed("owner", "owner_override")),
        entry("rejected", F.when(F.col("module") == "", NO_MODULE).otherwise(F.col("module")), F.lit(""), F.col("status") == "rejected"),
    )
    found = both.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e.kind", "e.from", "e.to").agg(F.count("*").alias("n"))
    return found.withColumn("suggested", (F.col("kind") != "rejected") & (F.col("n") >= SUGGESTED_FROM))
