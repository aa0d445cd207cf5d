r"""Quality rules: per-document base rules, and cross-document line frequency per host.

Lines are normalised (lower case, runs of separators to one space, trimmed, digits to 0) and hashed. For each host the
distinct documents of a line are counted, where rows with the same text are one document. A line is boilerplate where at least
LINE_LEAST distinct documents and more than LINE_SHARE of its host's distinct documents have it; such lines are removed, and
a document is depleted, and rejected, if less than half of its words and fewer than MIN_WORDS remain.

Only DataFrame expressions. Counting first reduces to one row per (host, line, text), which deals a hot host or line over many
tasks; no step gathers a host.

Defined results. Null text counts as empty: all counts are 0 and base_failed is true. A null host is a host of its own. Rows
that repeat an id, or have none, keep their own verdicts: a row is told by its id and text. Texts are taken whole whatever their length.
No verdict hangs on an order, so ties have no influence. Extra columns, whatever their names, pass through rules_applied() and are
ignored by verdicts(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm._store import materialise

MIN_WORDS = 20
REPEAT_PERCENT = 30
LINE_LEAST = 20
LINE_SHARE = 0.05
#: Boilerplate lines (about 40 bytes each) that may be broadcast; more are joined by a salted shuffle, as each is frequent.
BROADCAST_ROWS = 500_000
SALTS = 16
_SEP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SEP), lambda x: x != "")


def _has_word(line: Column) -> Column:
    return F.translate(line, " \t\n\x0b\x0c\r", "") != ""


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), _SEP, " ")), "[0-9]", "0")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    d = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_h", F.transform(words_of(F.col("_t")), lambda x: F.xxhash64(x)))
    eight = F.when(F.size("_h") >= 8, F.transform(F.sequence(F.lit(1), F.size("_h") - 7), lambda i: F.xxhash64(F.slice(F.col("_h"), i, 8)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_w", eight)
    ordered = F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), ordered))
    near = lambda e, i: (F.get("_s", i - 1)["h"] == e["h"]) | (F.get("_s", i + 1)["h"] == e["h"])
    twice = F.filter("_s", lambda e, i: F.coalesce(near(e, i), (i > 0) & (F.get("_s", i - 1)["h"] == e["h"]), F.get("_s", i + 1)["h"] == e["h"], F.lit(False)))
    d = d.withColumn("_p", F.array_sort(F.transform(twice, lambda e: e["p"])))
    span = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("_p", i + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("_t", "\n", -1), _has_word)
    d = d.withColumns(
        {
            "n_words": F.size("_h").cast("long"),
            "word_chars": F.length(F.regexp_replace("_t", _SEP, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(span, F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_t", "_h", "_w", "_s", "_p")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines of each document, boilerplate lines of each host)."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    d = d.withColumn("tid", F.xxhash64("t"))
    lines = d.select("doc_id", "host", "tid", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).where(_has_word(F.col("line")))
    lines = lines.select("doc_id", "host", "tid", "pos", F.xxhash64(normal_line(F.col("line"))).alias("lh"), F.size(words_of(F.col("line"))).alias("lw"))
    lines = materialise(lines, "lines")  # read twice: hashes and sizes, far less than the texts
    size = d.groupBy("host", "tid").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    seen = lines.groupBy("host", "lh", "tid").agg(F.lit(1).alias("one")).groupBy("host", "lh").agg(F.count("*").alias("n")).where(F.col("n") >= LINE_LEAST)
    often = materialise(seen.join(size, "host").where(F.col("n") > LINE_SHARE * F.col("docs")).select("host", "lh"), "often")
    return lines, often


def _matching(lines: DataFrame, often: DataFrame) -> DataFrame:
    """The lines that are boilerplate of their host."""
    if often.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(often), ["host", "lh"])
    dealt = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("tid", F.lit(SALTS)).cast("int")).join(dealt, ["host", "lh", "salt"]).drop("salt")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, n_cut_words and kept; one row per row of docs."""
    base = base_counts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("tid", F.xxhash64(F.coalesce("text", F.lit(""))))).drop("text")
    lines, often = boilerplate(docs, id_col, text_col, host_col)
    cut = _matching(lines, often).groupBy("doc_id", "tid", "pos").agg(F.first("lw").alias("lw")).groupBy("doc_id", "tid").agg(F.sum("lw").alias("cut"))
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("tid").alias("_t"), "cut")
    out = base.join(cut, base["doc_id"].eqNullSafe(cut["_d"]) & (base["tid"] == cut["_t"]), "left").withColumn("n_cut_words", F.coalesce("cut", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_cut_words")
    depleted = (left < MIN_WORDS) & (2 * left < F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_cut_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def rules_applied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, all columns, with their boilerplate lines taken out of the text."""
    lines, often = boilerplate(docs, id_col, text_col, host_col)
    gone = _matching(lines, often).groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gid"), F.col("tid").alias("gtid"), "gone")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    base = base_counts(docs.select(F.col(f"`{id_col}`").alias("bid"), F.col(f"`{text_col}`").alias("text")).withColumn("btid", key)).select("bid", "btid", "base_failed")
    # written before it is filtered: a filter pushed into the array expressions would evaluate them once per element
    base = materialise(base, "base").where("base_failed").select("bid", "btid").distinct()
    # all other columns of a row are held in one struct, so that no name can clash
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(others or [F.lit(0)])).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tid", key)
    kept = rows.join(base, F.col("id").eqNullSafe(F.col("bid")) & (F.col("tid") == F.col("btid")), "left_anti")
    kept = kept.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("tid") == F.col("gtid")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    kept = kept.withColumn("new", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest))
    n_old, n_new = F.size(words_of(F.col("text"))), F.size(words_of(F.col("new")))
    kept = kept.where(F.col("gone").isNull() | ~((n_new < MIN_WORDS) & (2 * n_new < n_old)))
    size = F.when(F.col("gone").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return kept.select(*(F.col("new").alias(c) if c == text_col else size.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))
