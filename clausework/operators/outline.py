"""Operators over ordered blocks of documents and cells of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def heading_path(df: DataFrame, level: str, title: str, by: list[str], order: str, depth: int = 6, name: str = "path") -> DataFrame:
    """The titles of the open headings at each row; a heading closes all deeper ones. Null levels are no headings.

    One window for all levels: a level is open if its last heading stands behind the last of every shallower level.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for k in range(1, depth + 1):
        here = F.col(level) == k
        out = out.withColumns({f"_p{k}": F.max(F.when(here, F.col(order))).over(w), f"_t{k}": F.last(F.when(here, F.col(title)), ignorenulls=True).over(w)})
    open_ = []
    for k in range(1, depth + 1):
        above = [F.col(f"_p{j}") for j in range(1, k)]
        last = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(None)
        open_.append(F.when(F.coalesce(F.col(f"_p{k}") > last, F.col(f"_p{k}").isNotNull()), F.col(f"_t{k}")))
    return out.withColumn(name, F.array_compact(F.array(*open_))).drop(*[f"_{x}{k}" for x in "pt" for k in range(1, depth + 1)])


def packed(df: DataFrame, by: str, order: str, size: str, kind: str, section: str, budget: int) -> DataFrame:
    """df with `chunk`: blocks of a document packed in order, from 1.

    A chunk ends before a heading once it holds 35 % of the budget, before a new section once it holds half, before a block that
    would exceed the budget, and around each table. The state is sequential, so each document is folded as one group; a group
    is bounded by its document.
    """
    schema = StructType([*df.schema.fields, StructField("chunk", IntegerType())])
    full, third, half = budget, 0.35 * budget, 0.5 * budget

    def fold(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        chunk, held, count, at, out = 1, 0, 0, None, []
        for n, k, s in zip(pdf[size].tolist(), pdf[kind].tolist(), pdf[section].tolist(), strict=True):
            ends = (k == "heading" and held >= third) or k == "table" or (s != at and held >= half) or held + n > full
            if count and ends:
                chunk, held, count = chunk + 1, 0, 0
            if not count:
                at = s
            out.append(chunk)
            held, count = held + n, count + 1
            if k == "table":
                chunk, held, count = chunk + 1, 0, 0
        pdf["chunk"] = out
        return pdf

    return df.groupBy(by).applyInPandas(fold, schema)


def sections(df: DataFrame, by: list[str], order: str, text: str, ident: str) -> DataFrame:
    """Blocks of one section, wherever they stand: first place, texts and ids in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(ident).alias("i"))))
    out = df.groupBy(*by).agg(F.min(order).alias("first"), rows.alias("_r"))
    return out.select(*by, "first", F.array_join(F.transform("_r", lambda r: r["t"]), "\n").alias("text"), F.transform("_r", lambda r: r["i"]).alias("ids"))


def stride_rows(df: DataFrame, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """`limit` evenly spaced rows of each group, at places floor(i * n / limit); all rows of groups no larger."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1
    n = F.count("*").over(Window.partitionBy(*by))
    i = F.floor((F.col("_r") * limit + F.col("_n") - 1) / F.col("_n"))
    hit = (F.col("_n") <= limit) | ((i < limit) & (F.floor(i * F.col("_n") / limit) == F.col("_r")))
    return df.withColumns({"_r": r, "_n": n}).where(hit).drop("_r", "_n")


def conservation(units: DataFrame, dispositions: DataFrame, key: str) -> DataFrame:
    """One row: units without a disposition, dispositions without a unit, units with several; all 0 if conserved."""
    a = units.select(key).distinct().withColumn("_u", F.lit(1))
    b = dispositions.groupBy(key).agg(F.count("*").alias("_d"))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("_d").isNull()).alias("missing"), F.count_if(F.col("_u").isNull()).alias("extra"), F.count_if((F.col("_d") > 1) & F.col("_u").isNotNull()).alias("duplicate"))


def later_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows by key; a later frame's row replaces an earlier one's. A grouped maximum, which combines before it shuffles."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_i", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_i")]
    return out.groupBy(key).agg(F.max(F.struct("_i", *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolutions(df: DataFrame, key: str, positive: str, negative: str) -> DataFrame:
    """conflict, covered, excluded or open for each key, from boolean evidence rows."""
    p, n = F.coalesce(F.bool_or(positive), F.lit(False)), F.coalesce(F.bool_or(negative), F.lit(False))
    return df.groupBy(key).agg(F.when(p & n, "conflict").when(p, "covered").when(n, "excluded").otherwise("open").alias("resolution"))


def merged_states(existing: DataFrame, generated: DataFrame, key: str, expert: str) -> DataFrame:
    """Keyed merge: an expert's row stays, otherwise the generated row replaces the existing one."""
    cols = [c for c in generated.columns if c != key]
    a = existing.select(key, F.struct(*cols).alias("_a"), F.coalesce(F.col(expert), F.lit(False)).alias("_x"))
    b = generated.select(key, F.struct(*cols).alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("_r", F.when(F.col("_x") | F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_b")))
    return both.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def majority_columns(cells: DataFrame, table: str, column: str, marked: str) -> DataFrame:
    """Columns whose non-blank cells are marked to at least one half; the first column never is."""
    out = cells.where(F.col(column) > 1).groupBy(table, column).agg(F.count_if(marked).alias("markers"), F.count("*").alias("cells"))
    return out.where((F.col("markers") > 0) & (2 * F.col("markers") >= F.col("cells")))


def merged_fill(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """cells (by, row, col, text) where blank cells of a merged range (r1, c1, r2, c2) take its anchor's text.

    Ranges are laid out as the cells they cover, so both joins are on equal keys.
    """
    anchor = cells.select(*by, F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("text").alias("_fill"))
    laid = ranges.join(anchor, [*by, "r1", "c1"]).withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    laid = laid.groupBy(*by, "row", "col").agg(F.min("_fill").alias("_fill"))
    own = F.nullif(F.trim("text"), F.lit(""))
    return cells.join(laid, [*by, "row", "col"], "left").withColumn("text", F.coalesce(own, F.col("_fill"), F.lit(""))).select(cells.columns)


def overlapping(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, n: rows whose closed interval begins before an earlier one of the group has ended; one sort, no pairs."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", before).groupBy(*by).agg(F.count_if(F.col("_b") >= F.col(start)).alias("n"))


#: Characters of a vocabulary that may be broadcast.
TERM_CHARS = 4_000_000


def term_matches(df: DataFrame, text: str, terms: DataFrame, entry: str, term: str) -> DataFrame:
    """Rows of df with the terms their lower-case text contains as whole words or plurals.

    Each term is indexed by its first word (a single word also by its plurals), a term without one by its first character beyond ASCII, so
    that the join is on equal keys and only rows that share one are verified; terms of signs alone are held against every row. Terms
    without Latin letters or digits are found anywhere. Terms are a vocabulary: they are broadcast up to TERM_CHARS characters in all, else shuffled.
    """
    lower, low = F.lower(term), F.lower(F.coalesce(F.col(text), F.lit("")))
    first, other = F.regexp_extract(lower, "[a-z0-9]+", 0), F.regexp_extract(lower, r"[^\x00-\x7f]", 0)
    keys = F.when(first == "", F.array(F.when(other == "", "*").otherwise(other))).when(lower == first, F.array(first, F.concat(first, F.lit("s")), F.concat(first, F.lit("es")))).otherwise(F.array(first))
    index = terms.where(F.col(term) != "").select(F.col(entry).alias("_e"), lower.alias("_t"), F.explode(keys).alias("_k"))
    index = F.broadcast(index) if (terms.agg(F.sum(F.length(term))).first()[0] or 0) <= TERM_CHARS else index
    found = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    words = df.withColumn("_k", F.explode(F.array_distinct(F.concat(F.array(F.lit("*")), found("[a-z0-9]+"), found(r"[^\x00-\x7f]")))))
    plain = F.concat(F.lit(r"\Q"), F.col("_t"), F.lit(r"\E"))
    whole = F.when(F.col("_t").rlike("[a-z0-9]"), F.concat(F.lit("(?:^|[^a-z0-9])"), plain, F.lit("(?:e?s)?(?:[^a-z0-9]|$)"))).otherwise(plain)
    hit = words.join(index, "_k").where(F.regexp_like(low, whole))
    return hit.select(*df.columns, F.col("_e").alias(entry), F.col("_t").alias(term)).distinct()
