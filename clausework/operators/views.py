"""Views of ledgers, conservation checks, evaluations over thresholds, gates and verdicts on a whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators import windows

GATE_PASS, GATE_WORK = "pass", "needs_work"
READY_COVERAGE, READY_QUESTIONS = 60.0, 30
# fixed values
REVIEW_REASONS = ("ambiguous_table_structure", "weak_signal_table_cell", "unsignaled_table_cell", "rejected_matrix_marker_cell", "untyped_colon_spec_cell", "parse_incomplete_table_cell", "normative_context_conflict")


def listed(rows: DataFrame, by: list[str], order: list[str], limit: int = 100, offset: int = 0, **wanted: str) -> DataFrame:
    """A page of the rows whose columns have the wanted values (empty ones let all pass), with the total of such rows."""
    for column, value in wanted.items():
        if value:
            rows = rows.where(F.col(column) == value)
    return windows.page(rows, by, order, limit, offset)


def claim_catalog(claims: DataFrame, effective: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """claims with their effective resolution, the number of their groups, and whether a structural reason asks for review.

    claims: key, owner, reason; effective: key, resolution; groups: key.
    """
    n = groups.groupBy(key).agg(F.count("*").alias("n_groups"))
    out = claims.join(effective, key, "left").join(n, key, "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    return out.withColumn("review", F.when(F.coalesce("reason", F.lit("")).isin(*REVIEW_REASONS), "pending_review"))


def coverage_groups(groups: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """groups (key, group_id) with status (validated or invalid), why, and whether a validation was reused. facts: group_id, valid, reason, reused."""
    g = groups.join(facts, "group_id", "left")
    ok = F.coalesce("valid", F.lit(False))
    return g.select(key, "group_id", F.when(ok, "validated").otherwise("invalid").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("reused", F.lit(False)).alias("reused"))


def conserved(expected: DataFrame, actual: DataFrame, by: list[str], key: str, verdict: str, allowed: tuple[str, ...]) -> DataFrame:
    """by, missing, extra, duplicate, invalid, ok: what a table of verdicts lacks or has too much beside the cells expected."""
    e = expected.select(*by, key).distinct().withColumn("_e", F.lit(1))
    a = actual.groupBy(*by, key).agg(F.count("*").alias("_n"), F.count_if(~F.coalesce(F.col(verdict).isin(*allowed), F.lit(False))).alias("_bad"))
    g = e.join(a, [*by, key], "full_outer").groupBy(*by).agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("duplicate"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid"))
    return g.withColumn("ok", (F.col("missing") + F.col("extra") + F.col("duplicate") + F.col("invalid")) == 0)


def cell_conservation(cells: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """by, cells, own, covered, missing, extra of units (kind, cell_id, covers) over cells (cell_id): each cell is a unit's own or covered by one."""
    own = units.where("kind = 'table_cell' and cell_id <> ''").select(*by, "cell_id", F.lit(1).alias("_own"), F.lit(None).cast("int").alias("_cov"))
    cov = units.select(*by, F.explode("covers").alias("cell_id"), F.lit(None).cast("int").alias("_own"), F.lit(1).alias("_cov"))
    u = own.unionByName(cov).groupBy(*by, "cell_id").agg(F.max("_own").alias("_own"), F.max("_cov").alias("_cov"))
    j = cells.select(*by, "cell_id").distinct().withColumn("_c", F.lit(1)).join(u, [*by, "cell_id"], "full_outer")
    held = F.col("_own").isNotNull() | F.col("_cov").isNotNull()
    return j.groupBy(*by).agg(F.count("_c").alias("cells"), F.count("_own").alias("own"), F.count_if(F.col("_c").isNotNull() & F.col("_cov").isNotNull() & F.col("_own").isNull()).alias("covered"), F.count_if(F.col("_c").isNotNull() & ~held).alias("missing"), F.count_if(F.col("_c").isNull()).alias("extra"))


def overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """tid, pid: entries and products of one section that share a coordinate. truth: tid, section, coords; found: pid, section, coords."""
    t = truth.where("section <> ''").select("tid", "section", F.explode("coords").alias("x"))
    p = found.where("section <> ''").select("pid", "section", F.explode("coords").alias("x"))
    return t.where("trim(x) <> ''").join(p, ["section", "x"]).select("tid", "pid").distinct()


def evaluation(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts, recall and precision of overlaps, and the ids on either side that meet none (in order)."""
    o = overlaps(truth, found)
    side = lambda df, key, other: df.select(key).distinct().join(o.select(key).distinct().withColumn("_h", F.lit(1)), key, "left").agg(F.count("*").alias(f"n_{other}"), F.count("_h").alias(f"hit_{other}"), F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.col(key)))).alias(f"miss_{other}"))
    out = side(truth, "tid", "truth").join(F.broadcast(side(found, "pid", "found")))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return out.withColumns({"recall": share("hit_truth", "n_truth"), "precision": share("hit_found", "n_found")})


def threshold_sweep(pairs: DataFrame, grid: list[dict[str, int]]) -> DataFrame:
    """One row for each setting: drilled pairs, recall of those that need it, precision. pairs: needs (boolean), and a count for each key of a
    setting; a pair is drilled where any count reaches its threshold."""
    cells = []
    for g in grid:
        hit = F.lit(False)
        for k, v in g.items():
            hit = hit | (F.col(k) >= v)
        cells.append(F.struct(F.lit(",".join(f"{k}={v}" for k, v in g.items())).alias("setting"), hit.alias("hit")))
    r = pairs.select("needs", F.explode(F.array(*cells)).alias("s")).groupBy("s.setting").agg(F.count_if("s.hit").alias("drilled"), F.count_if(F.col("s.hit") & F.col("needs")).alias("tp"), F.count_if("needs").alias("pos"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return r.select("setting", "drilled", share("tp", "pos").alias("recall"), share("tp", "drilled").alias("precision"))


def execution_gate(status: Column, conservation_ok: Column) -> Column:
    """(execution, conservation): a stage passes with status ok, obligations with a closed balance; null is missing."""
    return F.struct(F.when(F.coalesce(status, F.lit("")) == "ok", GATE_PASS).otherwise(GATE_WORK).alias("execution"), F.when(F.coalesce(conservation_ok, F.lit(False)), GATE_PASS).otherwise(GATE_WORK).alias("conservation"))


def readiness(failed: Column, core: Column, legacy: Column, blocking: Column, internal: Column, questions: Column, least: float = READY_COVERAGE, most: int = READY_QUESTIONS) -> Column:
    """(ready, basis, reasons): nothing failed, coverage (of the core, else the old figure) high enough, nothing blocking, few questions."""
    coverage = F.coalesce(core, legacy)
    basis = F.when(core.isNotNull(), "core").when(legacy.isNotNull(), "legacy").otherwise("unavailable")
    why = F.array_compact(F.array(F.when(failed > 0, "failed_units"), F.when(coverage < least, "coverage"), F.when(blocking > 0, "blocking"), F.when(internal > 0, "internal"), F.when(questions > most, "questions")))
    return F.struct((F.size(why) == 0).alias("ready"), basis.alias("basis"), why.alias("reasons"))


def merged_lists(structural: DataFrame, others: DataFrame) -> DataFrame:
    """Rows with a table of thresholds that has rows, marked as deterministic, before all rows of the other list."""
    a = structural.where(F.size(F.coalesce("threshold_rows", F.array().cast("array<string>"))) > 0).select("id", F.coalesce("extracted_by", F.lit("deterministic")).alias("extracted_by"), F.lit(0).alias("side"))
    return a.unionByName(others.select("id", "extracted_by", F.lit(1).alias("side")))
