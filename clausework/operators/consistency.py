"""Quotes, echoes and coverage: which blocks a quote comes from, what is covered, what repeats, what disagrees.

Blocks: by (the document), ord, block_id, text, noise. Texts are compared without blanks and case. A quote meets the blocks of its own
document only; those are held in one row per document, so the work grows with quotes and documents, not with pairs of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import guards, records, scalars

# fixed values
LEAST_QUOTE, LEAST_MATCH, WIDEST, LEAST_SHARE = 12, 12, 12, 0.75
EXCERPT_CUT = r"(?:\r?\n+|\.{3,}|…+)"


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def _document(blocks: DataFrame, by: str) -> DataFrame:
    """by, segs, noise: runs of neighbouring blocks long enough to match, each as blocks (id, text, start) and their joined text."""
    b = blocks.withColumn("_c", compact(F.col("text"))).withColumn("_noise", F.coalesce("noise", F.lit(False)))
    loud = b.where("_noise").where(F.length("_c") >= LEAST_MATCH).groupBy(by).agg(F.collect_set("_c").alias("noise"))
    order = Window.partitionBy(by).orderBy("ord", "block_id")
    quiet = b.where("not _noise").withColumn("_run", F.sum((F.length("_c") < LEAST_MATCH).cast("int")).over(order)).where(F.length("_c") >= LEAST_MATCH)
    start = F.sum(F.length("_c")).over(Window.partitionBy(by, "_run").orderBy("ord", "block_id").rowsBetween(Window.unboundedPreceding, -1))
    quiet = quiet.withColumn("_start", F.coalesce(start, F.lit(0)).cast("int"))
    seg = quiet.groupBy(by, "_run").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", F.col("_c").alias("c"), F.col("_start").alias("start")))).alias("bs"))
    seg = seg.withColumn("all", F.array_join(F.transform("bs", lambda x: x["c"]), ""))
    return seg.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_run").alias("run"), "bs", "all"))).alias("segs")).join(loud, by, "full_outer")


def _ids(blocks: Column) -> Column:
    return F.transform(blocks, lambda x: x["block_id"])


def _windows(seg: Column, quote: Column, at: Column) -> Column:
    """(width, ord, ids) of the blocks that the quote spans from each of its offsets in a run."""
    def one(off: Column) -> Column:
        over = F.filter(seg["bs"], lambda x: (x["start"] < off + F.length(quote)) & (x["start"] + F.length(x["c"]) > off))
        return F.struct(F.size(over).alias("w"), F.get(over, F.lit(0))["ord"].alias("o"), _ids(over).alias("ids"))

    return F.filter(F.transform(at, one), lambda x: x["w"].between(2, WIDEST))


def match_excerpts(excerpts: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """excerpts (by, quote in compact form, more columns) with ids, method and noise_only."""
    d = excerpts.join(_document(blocks, by), by, "left")
    q = F.col("quote")
    none = F.array().cast("array<string>")
    segs = F.coalesce("segs", F.filter(F.array(F.col("segs")[0]), lambda _: F.lit(False)))
    every = F.flatten(F.transform(segs, lambda s: s["bs"]))
    d = d.withColumn("_bs", every)
    exact = _ids(F.filter("_bs", lambda x: x["c"] == q))
    within = _ids(F.filter("_bs", lambda x: F.contains(x["c"], q)))
    holds = _ids(F.filter("_bs", lambda x: F.contains(q, x["c"]) & (F.length(x["c"]) / F.length(q) >= LEAST_SHARE)))

    def offsets(s: Column) -> Column:
        parts = F.split(s["all"], F.concat(F.lit(r"\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)
        ends = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * F.length(q)
        return F.when(F.size(parts) > 1, F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: ends(i))).otherwise(F.array().cast("array<int>"))

    spans = F.flatten(F.transform(segs, lambda s: _windows(s, q, offsets(s))))

    def inner(s: Column) -> Column:
        def width(w: Column) -> Column:
            last = F.size(s["bs"]) - w + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            run = lambda i: F.slice(s["bs"], i, w)
            text = lambda i: F.array_join(F.transform(run(i), lambda x: x["c"]), "")
            hit = F.filter(starts, lambda i: F.contains(q, text(i)) & (F.length(text(i)) / F.length(q) >= LEAST_SHARE))
            return F.transform(hit, lambda i: F.struct(w.cast("int").alias("w"), F.get(run(i), F.lit(0))["ord"].alias("o"), _ids(run(i)).alias("ids")))

        return F.flatten(F.transform(F.sequence(F.lit(2), F.lit(WIDEST)), width))

    d = d.withColumns({"_e": exact, "_w": within, "_h": holds})
    first = lambda xs: F.array_min(xs)["ids"]
    whole = F.when(F.size("_e") > 0, F.col("_e")).when(F.size("_w") > 0, F.col("_w")).when(F.size("_h") > 0, F.col("_h"))
    d = d.withColumn("_a", whole)
    d = d.withColumn("_m", F.when(F.col("_a").isNull(), F.coalesce(first(spans), first(F.flatten(F.transform(segs, inner))))))
    ids = F.coalesce("_a", "_m", none)
    method = F.when(F.size("_a") == 1, F.when(F.size("_e") > 0, "exact").otherwise("contains")).when((F.size("_a") > 1) | F.col("_m").isNotNull(), "multi_block").otherwise("")
    noise = F.exists(F.coalesce("noise", none), lambda x: F.contains(x, q))
    return d.select(*excerpts.columns, ids.alias("ids"), method.alias("method"), F.coalesce(noise, F.lit(False)).alias("noise_only"))


def match_quotes(quotes: DataFrame, blocks: DataFrame, by: str, key: str, quote: str) -> DataFrame:
    """by, key, block_ids, method: the blocks each quote comes from; a quote of several excerpts needs a block for each, noise aside."""
    cut = F.filter(F.transform(F.split(F.coalesce(F.col(quote), F.lit("")), EXCERPT_CUT), compact), lambda x: F.length(x) >= LEAST_MATCH)
    whole = compact(F.col(quote))
    parts = F.when(F.size(cut) > 1, cut).when(F.length(whole) >= LEAST_MATCH, F.array(whole)).otherwise(F.array().cast("array<string>"))
    q = quotes.select(by, key, F.posexplode_outer(parts).alias("i", "quote"))
    found = match_excerpts(q.where("quote is not null"), blocks, by)
    miss = F.bool_or((F.size("ids") == 0) & ~(F.col("noise_only") & (F.col("n") > 1)))
    n = q.where("quote is not null").groupBy(by, key).agg(F.count("*").alias("n"))
    g = found.join(n, [by, key]).groupBy(by, key).agg(miss.alias("miss"), F.max("n").alias("n"), F.max("method").alias("one"), F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    ids = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["ids"])))
    g = g.select(by, key, F.when(F.col("miss"), F.array().cast("array<string>")).otherwise(ids).alias("block_ids"), "n", "one")
    out = quotes.select(by, key).join(g, [by, key], "left").withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))
    method = F.when(F.size("block_ids") == 0, "").when(F.col("n") == 1, F.col("one")).when(F.size("block_ids") > 1, "multi_block").otherwise("contains")
    return out.select(by, key, "block_ids", method.alias("method"))


def covered(matches: DataFrame, by: str, more: DataFrame | None = None) -> DataFrame:
    """by, block_id: blocks that a quote matches, or that `more` (by, block_id) maps reliably."""
    out = matches.select(by, F.explode("block_ids").alias("block_id"))
    return (out if more is None else out.unionByName(more.select(by, "block_id"))).distinct()


def coverage_gaps(candidates: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """by, total, covered, ratio, uncovered ids in order: different candidate texts and those that a covered block has."""
    norm = records.plain_text(F.col("text"))
    c = candidates.withColumns({"_n": norm, "_c": compact(F.col("text"))}).where("_n <> ''").join(done.withColumn("_d", F.lit(1)), [by, "block_id"], "left")
    texts = c.groupBy(by, "_c").agg(F.max("_d").alias("_t"))
    first = c.groupBy(by, "_n").agg(F.min_by(F.struct("ord", "block_id", "_c", "_d"), F.struct("ord", "block_id")).alias("f")).select(by, "f.*")
    first = first.join(texts, [by, "_c"]).withColumn("_ok", F.coalesce("_d", "_t").isNotNull())
    g = first.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_ok").alias("covered"), F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("ord", "block_id")))).alias("u"))
    return g.select(by, "total", "covered", F.round(F.col("covered") / F.col("total"), 4).alias("ratio"), F.transform("u", lambda x: x["block_id"]).alias("uncovered"))


def layered_coverage(candidates: DataFrame, quotes: DataFrame, blocks: DataFrame, by: str, key: str, quote: str) -> DataFrame:
    """coverage_gaps by layer: compliance (blocks that compliance rows quote, or that read so) and core."""
    is_law = guards.is_compliance(F.col(quote))
    law, core = quotes.where(is_law), quotes.where(~is_law)
    law_done, core_done = covered(match_quotes(law, blocks, by, key, quote), by), covered(match_quotes(core, blocks, by, key, quote), by)
    c = candidates.join(law_done.withColumn("_l", F.lit(True)), [by, "block_id"], "left").withColumn("_l", F.coalesce("_l", guards.is_compliance(F.col("text"))))
    a = coverage_gaps(c.where("not _l").drop("_l"), core_done, by).withColumn("layer", F.lit("core"))
    return a.unionByName(coverage_gaps(c.where("_l").drop("_l"), law_done, by).withColumn("layer", F.lit("compliance")))


def echoes(rows: DataFrame, blocks: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, block_id: other blocks that say the same: they hold the quote or are held by it (30 characters), or equal a source block of 60
    characters, or nearly so (trigrams 0.8, same numbers). rows: by, key, quote (compact), source_ids.

    Near blocks are found by their numbers and then compared, so blocks meet within a document and equal number sets only.
    """
    b = blocks.withColumns({"_c": compact(F.col("text")), "_m": F.array_join(scalars.numbers(F.col("text")), " ")}).where("not coalesce(noise, false)").where(F.length("_c") >= 30)
    near = rows.select(by, key, "quote", "source_ids", F.explode("source_ids").alias("_s")).join(blocks.select(by, F.col("block_id").alias("_s"), F.col("text").alias("_ref")), [by, "_s"])
    near = near.withColumn("_m", F.array_join(scalars.numbers(F.col("_ref")), " ")).where(F.length(compact(F.col("_ref"))) >= 60)
    same = near.join(b.where(F.length("_c") >= 60), [by, "_m"]).where((F.col("_c") == compact(F.col("_ref"))) | (scalars.gram_jaccard(F.col("text"), F.col("_ref")) >= 0.8))
    quoted = rows.where(F.length("quote") >= 30).join(b, by).where(F.contains("_c", F.col("quote")) | F.contains("quote", F.col("_c")))
    out = same.select(by, key, "source_ids", "block_id").unionByName(quoted.select(by, key, "source_ids", "block_id"))
    return out.where(~F.array_contains("source_ids", F.col("block_id"))).select(by, key, "block_id").distinct()


def duplicates(rows: DataFrame, key: str, quote: str, section: str) -> DataFrame:
    """quote, members, sections, n: quotes of 12 characters or more that several rows share, case and blanks aside."""
    r = rows.withColumn("_n", records.plain_text(F.col(quote))).where(F.length("_n") >= LEAST_QUOTE)
    g = r.groupBy("_n").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(key))).alias("members"), F.array_sort(F.collect_set(F.nullif(F.col(section), F.lit("")))).alias("sections"))
    return g.where("n > 1").select(F.col("_n").alias("quote"), "members", "sections", "n")


def coreferences(rows: DataFrame, key: str, text: str, section: str) -> DataFrame:
    """code, members, sections, n, values_differ: codes that several rows name, and whether their other integers differ."""
    codes = scalars.codes(F.col(text))
    ints = lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    other = F.array_sort(F.array_except(ints(F.coalesce(F.col(text), F.lit(""))), ints(F.array_join(codes, " "))))
    r = rows.select(key, section, F.array_join(other, " ").alias("_i"), F.explode(codes).alias("code"))
    g = r.groupBy("code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("members"), F.array_sort(F.collect_set(F.nullif(F.col(section), F.lit("")))).alias("sections"), (F.min("_i") != F.max("_i")).alias("values_differ"))
    return g.where("n > 1")


def suspects(dups: DataFrame, refs: DataFrame, gaps: DataFrame) -> DataFrame:
    """kind, members, evidence: repeated quotes, codes whose values differ, blocks that nothing covers (member)."""
    a = dups.select(F.lit("cross_section_duplicate").alias("kind"), F.col("members").cast("array<string>").alias("members"), F.col("quote").alias("evidence"))
    b = refs.where("values_differ").select(F.lit("obis_value_divergence").alias("kind"), F.col("members").cast("array<string>").alias("members"), F.col("code").alias("evidence"))
    return a.unionByName(b).unionByName(gaps.select(F.lit("coverage_gap").alias("kind"), F.array(F.col("member").cast("string")).alias("members"), F.lit("").alias("evidence")))


def evidence_failures(members: DataFrame, blocks: DataFrame, matches: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, codes: codes of a row's text that none of its source blocks or matched blocks holds; rows without any pass.

    members: by, key, text, source_ids.
    """
    m = members.join(matches.select(by, key, "block_ids"), [by, key], "left").withColumn("_b", F.explode_outer(F.array_union("source_ids", F.coalesce("block_ids", F.array().cast("array<string>")))))
    m = m.join(blocks.select(by, F.col("block_id").alias("_b"), scalars.codes(F.col("text")).alias("_codes")), [by, "_b"], "left")
    g = m.groupBy(by, key, "text").agg(F.flatten(F.collect_list(F.coalesce("_codes", F.array().cast("array<string>")))).alias("known"))
    return g.select(by, key, F.array_except(scalars.codes(F.col("text")), "known").alias("codes")).where(F.size("codes") > 0)
