"""Event ledgers and what is folded from them: states, decisions, hash chains, banks, and the reports that count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records, scalars

# fixed values
TRANSITIONS = {
    "candidate": ("llm_reviewed", "rejected"),
    "llm_reviewed": ("expert_pending", "accepted", "flagged", "rejected"),
    "expert_pending": ("accepted", "rejected", "needs_discussion", "needs_rework"),
    "needs_discussion": ("expert_pending", "rejected"),
    "needs_rework": ("candidate", "llm_reviewed"),
    "flagged": ("expert_pending", "rejected"),
    "accepted": ("frozen",),
    "rejected": (),
    "frozen": (),
}
EXPERT_DECISIONS = ("accepted", "rejected", "needs_discussion", "expert_pending")
EMPTY_HASH = "sha256:" + "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
COVERAGE_LABELS = ("安全", "事件记录", "通信协议", "Push", "计量", "时钟", "费率", "升级", "需量", "状态字")


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another."""
    out = F.lit(False)
    for state, nexts in TRANSITIONS.items():
        out = out | ((before == state) & after.isin(*nexts)) if nexts else out
    return F.coalesce(out, F.lit(False))


def transitions(events: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """events with `before` (candidate at first) and `valid`: whether this and all steps before it are allowed."""
    w = Window.partitionBy(key).orderBy(order)
    e = events.withColumn("before", F.lag(to, 1, "candidate").over(w))
    return e.withColumn("valid", F.min(allowed(F.col("before"), F.col(to)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def states(events: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """key, status, steps, refused: the state after the valid steps; steps from the first refused one on do not count."""
    t = transitions(events, key, order, to)
    return t.groupBy(key).agg(F.coalesce(F.max_by(F.when(F.col("valid"), F.col(to)), F.when(F.col("valid"), F.col(order))), F.lit("candidate")).alias("status"), F.count_if("valid").alias("steps"), F.count_if(~F.col("valid")).alias("refused"))


def expert_decisions(now: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """key, status, refusal: the decision where it is an expert's and allowed from the present state, else the present state and why.

    decisions: key, decision, expected (the state the expert saw, or null).
    """
    d = now.join(decisions, key, "left")
    why = (
        F.when(F.col("decision").isNull(), None)
        .when(~F.col("decision").isin(*EXPERT_DECISIONS), "unknown_status")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.col("status")), "authority_conflict")
        .when(~allowed(F.col("status"), F.col("decision")), "invalid_transition")
    )
    return d.withColumn("refusal", why).select(key, F.when(F.col("decision").isNotNull() & F.col("refusal").isNull(), F.col("decision")).otherwise(F.col("status")).alias("status"), "refusal")


def stub_states(reviews: DataFrame, key: str) -> DataFrame:
    """key, status, history of a requirement after the rule review (decision)."""
    last = F.when(F.col("decision") == "needs_expert", "expert_pending").when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "reject", "rejected").otherwise("flagged")
    return reviews.select(key, last.alias("status"), F.array(F.lit("candidate"), F.lit("llm_reviewed"), last).alias("history"))


def upserted(records_: DataFrame, key: list[str], order: str, body: str) -> DataFrame:
    """key, body: maps of one key put over one another in order, later values winning; rows with an empty key are refused."""
    ok = F.lit(True)
    for k in key:
        ok = ok & (F.coalesce(F.col(k), F.lit("")) != "")
    g = records_.where(ok).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("m"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("s"))
    merged = F.aggregate("s", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(x["m"], k)), x["m"]))
    return g.select(*key, merged.alias(body))


def edge_events(events: DataFrame) -> DataFrame:
    """events (from, to, kind, decision) with their edge id; events that lack an end or a kind are refused."""
    ok = (F.coalesce("from", F.lit("")) != "") & (F.coalesce("to", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "")
    return events.where(ok).withColumn("edge_id", scalars.edge_id(F.col("from"), F.col("to"), F.col("kind")))


def chained(events: DataFrame, log: str, seq: str, prev: str, own: str, payload: str, idem: str) -> DataFrame:
    """log, n, valid, last_hash, repeats: the rows before the first that breaks the chain (place, previous hash, own hash, repeated key)."""
    w = Window.partitionBy(log).orderBy(seq)
    at = F.row_number().over(w)
    before = F.lag(own, 1, EMPTY_HASH).over(w)
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", F.col(prev), F.col(payload)), 256))
    again = F.row_number().over(Window.partitionBy(log, idem).orderBy(seq)) > 1
    e = events.withColumns({"_at": at, "_before": before, "_again": again})
    ok = (F.col(seq) == F.col("_at")) & (F.col(prev) == F.col("_before")) & (F.col(own) == hashed) & ~F.col("_again")
    e = e.withColumn("_ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return e.groupBy(log).agg(F.count("*").alias("n"), F.count_if("_ok").alias("valid"), F.coalesce(F.max_by(F.when(F.col("_ok"), F.col(own)), F.when(F.col("_ok"), F.col(seq))), F.lit(EMPTY_HASH)).alias("last_hash"), F.count_if("_again").alias("repeats"))


# --- banks and libraries


def bank(rows: DataFrame) -> DataFrame:
    """rows (id, status, suspicious, module, module_override) that a bank of examples takes: side (accepted or rejected) and module."""
    take = F.when((F.col("status") == "accepted") & ~F.coalesce("suspicious", F.lit(False)), "accepted").when(F.col("status") == "rejected", "rejected")
    named = F.when(F.col("status") == "accepted", F.coalesce(F.nullif("module_override", F.lit("")), "module")).otherwise(F.col("module"))
    return rows.withColumn("side", take).where("side is not null").select("id", "side", F.trim(F.coalesce(named, F.lit(""))).alias("module"))


def vocabulary(banked: DataFrame) -> DataFrame:
    """module, n of accepted examples."""
    return banked.where("side = 'accepted' and module <> ''").groupBy("module").agg(F.count("*").alias("n"))


def match_tokens(text: Column) -> Column:
    """Words of two characters or more in lower case, and pairs of neighbouring CJK characters whatever stands between; distinct."""
    t = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9_.\-]{2,}"), F.lit(0)), lambda x: F.lower(x))
    han = F.regexp_extract_all(t, F.lit("[一-鿿]"), F.lit(0))
    return F.array_distinct(F.concat(words, F.zip_with(han, F.slice(han, 2, F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b))))


def exemplars(queries: DataFrame, examples: DataFrame, k: int = 2, budget: int = 1200, text: str = "text", size: str = "size") -> DataFrame:
    """qid, id, score: up to k examples of a query's module that share most tokens, as far as their sizes fit, the first in any case.

    queries: qid, module, text; examples: id, module, text, size. Queries of one module and token set have one answer, and of examples that
    agree in both only the k first can be in it; what is left meets on module and token.
    """
    tokens = F.array_sort(match_tokens(F.col(text)))
    q = queries.select("qid", "module", tokens.alias("qs"))
    first = Window.partitionBy("module", "es").orderBy("id")
    e = examples.select("id", "module", size, tokens.alias("es")).withColumn("i", F.row_number().over(first)).where(F.col("i") <= k).drop("i")
    asked = q.select("module", "qs").distinct().select("module", "qs", F.explode("qs").alias("tok"))
    hit = asked.join(e.select("id", "module", size, F.explode("es").alias("tok")), ["module", "tok"]).groupBy("module", "qs", "id", size).agg(F.count("*").alias("score"))
    ranked = Window.partitionBy("module", "qs").orderBy(F.desc("score"), "id")
    top = hit.withColumn("i", F.row_number().over(ranked)).where(F.col("i") <= k)
    so_far = Window.partitionBy("module", "qs").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("_fits", (F.col("i") == 1) | (F.sum(size).over(so_far) <= budget))
    top = top.withColumn("_all", F.min(F.col("_fits").cast("int")).over(so_far) == 1).where("_all")
    return q.join(top, ["module", "qs"]).select("qid", "id", "score")


def retrieve(queries: DataFrame, entries: DataFrame, least: int = 1, limit: int = 20) -> DataFrame:
    """qid, id, score: entries that share `least` tokens or more, by token Jaccard, corrected ones first among equals, then source and title.

    queries: qid, text; entries: id, text, corrected, source, title. Both meet on tokens; sizes give the union.
    """
    q = queries.select("qid", scalars.search_tokens(F.col("text")).alias("qs"))
    e = entries.select("id", "corrected", "source", "title", scalars.search_tokens(F.col("text")).alias("es"))
    a, b = q.select("qid", F.size("qs").alias("qn"), F.explode("qs").alias("tok")), e.select("id", "corrected", "source", "title", F.size("es").alias("en"), F.explode("es").alias("tok"))
    hit = a.join(b, "tok").groupBy("qid", "id", "qn", "en", "corrected", "source", "title").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    hit = hit.withColumn("score", F.col("both") / (F.col("qn") + F.col("en") - F.col("both")))
    i = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("corrected"), "source", "title", "id"))
    return hit.withColumn("rank", i).where(F.col("rank") <= limit).select("qid", "id", F.round("score", 4).alias("score"), "rank")


def library_hits(items: DataFrame, library: DataFrame) -> DataFrame:
    """hits: items with a token of the library."""
    known = library.select(F.explode(scalars.search_tokens(F.col("text"))).alias("tok")).distinct()
    return items.select("id", F.explode(scalars.search_tokens(F.col("text"))).alias("tok")).join(known, "tok", "left_semi").agg(F.count_distinct("id").alias("hits"))


def adopted(rows: DataFrame, prefix: str, parts: list[str], order: str) -> DataFrame:
    """entry_id and the first row of each identity (trimmed parts with bars); rows whose last part is empty are left out."""
    identity = F.concat_ws("|", *(F.trim(F.coalesce(p, F.lit(""))) for p in parts))
    r = rows.where(F.trim(F.coalesce(parts[-1], F.lit(""))) != "").withColumn("entry_id", F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, 16)))
    return r.groupBy("entry_id").agg(F.min(order).alias(order))


def dependencies(rows: DataFrame) -> DataFrame:
    """from_id, to_id, kind: rows that share an object code may depend on or exclude each other, those of adjacent sections refine.

    rows: ord, id, codes, parent (the section without its last number), last (that number, or null), section, title. Rows meet on a
    code, or on the parent of their section, so pairs of unrelated rows are never made.
    """
    a = rows.select(F.col("ord").alias("oa"), F.col("id").alias("a"), F.explode("codes").alias("code"))
    b = rows.select(F.col("ord").alias("ob"), F.col("id").alias("b"), F.explode("codes").alias("code"))
    shared = a.join(b, "code").where("oa < ob and a <> b").select(F.col("a").alias("from_id"), F.col("b").alias("to_id")).distinct()
    out = shared.withColumn("kind", F.explode(F.array(F.lit("depend"), F.lit("exclude"))))
    s = rows.where("last is not null").select("ord", "id", "parent", F.col("last").cast("long").alias("last"), F.length(F.coalesce("title", F.lit(""))).alias("n"))
    x, y = (s.select(*(F.col(c).alias(c + t) for c in s.columns)) for t in "xy")
    near = x.withColumn("k", F.explode(F.array(F.col("lastx") - 1, F.col("lastx"), F.col("lastx") + 1))).join(y, (F.col("parentx") == F.col("parenty")) & (F.col("k") == F.col("lasty"))).where("ordx < ordy and idx <> idy")
    first = F.col("nx") <= F.col("ny")
    near = near.select(F.when(first, F.col("idx")).otherwise(F.col("idy")).alias("from_id"), F.when(first, F.col("idy")).otherwise(F.col("idx")).alias("to_id"), F.lit("refine").alias("kind"))
    return out.select("from_id", "to_id", "kind").unionByName(near.distinct())


# --- merges and differences


def merged_equivalents(rows: DataFrame, key: list[str], order: str, lists: list[str]) -> DataFrame:
    """One row a key, the lists joined in order without repeats."""
    gather = lambda c: F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("x"))))
    g = rows.groupBy(*key).agg(F.min(order).alias(order), *(gather(c).alias(c) for c in lists))
    return g.select(*key, order, *(F.array_distinct(F.flatten(F.transform(c, lambda s: s["x"]))).alias(c) for c in lists))


def collapsed_attributes(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, default: equal attributes once; several observed values joined, else the first default that is not empty."""
    g = merged_equivalents(rows, key, order, ["observed"]).withColumnRenamed("observed", "_v")
    first = rows.where("default <> ''").groupBy(*key).agg(F.min_by("default", order).alias("_d"))
    return g.join(first, key, "left").select(*key, F.when(F.size("_v") > 1, F.array_join("_v", "; ")).otherwise(F.coalesce("_d", F.lit(""))).alias("default"))


def candidate_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change of clause candidates (key, section_path, heading, text, block_ids) by their hashes; of repeated keys the first counts (ord)."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        h = records.candidate_hash(F.col("section_path"), F.col("heading"), F.col("text"), F.col("block_ids"))
        return df.select(key, "ord", h.alias("h")).groupBy(key).agg(F.min_by("h", "ord").alias(name))

    both = hashed(old, "a").join(hashed(new, "b"), key, "full_outer")
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"))


def rerun_plan(diff: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """blocks, ratio: the distinct blocks of changed and added candidates, and their share of all new blocks."""
    b = new.groupBy(key).agg(F.max("block_ids").alias("block_ids"))
    hit = diff.where("change in ('changed', 'added')").join(b, key).select(F.explode("block_ids").alias("x")).distinct().agg(F.count("*").alias("blocks"))
    total = new.agg(F.greatest(F.lit(1), F.coalesce(F.sum(F.size("block_ids")), F.lit(0))).alias("total"))
    return hit.join(F.broadcast(total)).select("blocks", F.round(F.col("blocks") / F.col("total"), 4).alias("ratio"))


def changeset(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """key, state, reason: added, obsolete or retained requirements; retained ones tell whether a source block changed.

    old, new: key, block_ids; changed: block_id.
    """
    blocks = new.select(key, F.explode_outer("block_ids").alias("block_id")).join(changed.select("block_id").distinct().withColumn("_c", F.lit(1)), "block_id", "left")
    n = blocks.groupBy(key).agg((F.max("_c") == 1).alias("_hit"))
    both = old.select(key, F.lit(1).alias("_o")).join(n.withColumn("_n", F.lit(1)), key, "full_outer")
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "obsolete").otherwise("retained")
    reason = F.when(F.col("_o").isNull(), "new_requirement").when(F.col("_n").isNull(), "removed_requirement").when(F.coalesce("_hit", F.lit(False)), "source_changed").otherwise("unchanged")
    return both.select(key, state.alias("state"), reason.alias("reason"))


# --- reports


def label_gaps(rows: DataFrame, labels: str) -> DataFrame:
    """label: those of the checklist that no row carries."""
    have = rows.select(F.explode(labels).alias("label")).distinct()
    return rows.sparkSession.createDataFrame([(x,) for x in COVERAGE_LABELS], "label string").join(have, "label", "left_anti")


def counted(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of each stated column, from one pass; nulls count as unknown."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions)))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def quality_report(blocks: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts and shares: blocks (region, noise, text), items (item_id, region, tags), candidates (source_id, ambiguity, confidence)."""
    share = lambda a, b: F.when(F.col(b) == 0, None).otherwise(F.round(F.col(a) / F.col(b), 4))
    chars = F.length(F.coalesce("text", F.lit("")))
    b = blocks.agg(F.count("*").alias("blocks"), F.count_if("noise").alias("noise_blocks"), F.sum(F.when(F.col("noise"), chars).otherwise(0)).alias("noise_chars"), F.sum(chars).alias("chars"), F.count_if(F.coalesce("region", F.lit("body")) == "body").alias("body_blocks"))
    with_rows = items.join(candidates.select(F.col("source_id").alias("item_id")).distinct().withColumn("_c", F.lit(1)), "item_id", "left")
    body, tagged = F.col("region") == "body", F.size("tags") > 0
    i = with_rows.agg(F.count("*").alias("items"), F.count_if(body).alias("body_items"), F.count_if(body & tagged).alias("domain_items"), F.count_if(F.col("_c") == 1).alias("item_candidates"), F.count_if(body & tagged & (F.col("_c") == 1)).alias("domain_candidates"))
    c = candidates.agg(F.count("*").alias("requirements"), F.count_if("ambiguity").alias("ambiguous"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.75).alias("low_confidence"))
    out = b.join(F.broadcast(i)).join(F.broadcast(c))
    return out.withColumns({"noise_ratio": share("noise_chars", "chars"), "body_ratio": share("body_blocks", "blocks"), "item_ratio": share("item_candidates", "body_items"), "domain_ratio": share("domain_candidates", "domain_items")}).drop("noise_chars", "chars")


def table_status(rows: DataFrame, by: str) -> DataFrame:
    """by, status, reason of a table from its rows (status, reason): all skipped, some failed, or translated."""
    g = rows.groupBy(by).agg(F.count_if(F.col("status") == "failed").alias("f"), F.bool_and(F.col("status") == "skipped").alias("s"), F.min_by(F.nullif("reason", F.lit("")), F.when(F.coalesce("reason", F.lit("")) != "", F.col("ord"))).alias("r"))
    return g.select(by, F.when(F.col("s"), "skipped").when(F.col("f") > 0, "failed").otherwise("translated").alias("status"), F.when(F.col("s"), F.coalesce("r", F.lit("empty_table"))).when(F.col("f") > 0, F.concat(F.lit("table_rows_failed:"), F.col("f").cast("string"))).otherwise("").alias("reason"))
