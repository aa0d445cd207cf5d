"""The registered query of each operator, with production parameters over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausework.llm._store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS gram FROM g),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN g p ON p.doc_id = a JOIN g q ON q.doc_id = b WHERE 100 * c >= 85 * (len(p.gs) + len(q.gs) - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT g.doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON r.a = g.doc_id GROUP BY g.doc_id, gs
"""


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from clausework.llm.substring_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
v AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM x),
m AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM v JOIN m USING (win) WHERE least < doc_id),
l AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN l USING (doc_id)),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS t FROM (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)) u
  ANTI JOIN c ON c.doc_id = u.doc_id AND c.pos = u.i GROUP BY u.doc_id)
SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN kept USING (doc_id)
"""


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


ORACLE["op3_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS.format("text")} AS ws FROM documents),
v AS (SELECT doc_id, array_to_string(ws[i:i+7], ' ') AS win, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
m AS (SELECT doc_id, win FROM v GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM v JOIN m USING (doc_id, win)) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, line, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
k AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm FROM l WHERE len(lw) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
o AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM k GROUP BY 1, 2) JOIN h USING (host) WHERE n >= 20 AND n > 0.05 * docs),
c AS (SELECT doc_id, sum(len(lw)) AS cut FROM k JOIN o USING (host, norm) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cut, 0) AS BIGINT) AS n_cut_words
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_cut_words < 20 AND 2 * (n_words - n_cut_words) < n_words) AS kept FROM b
"""


@_query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "worst_start", "worst_end")


@_query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@_query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.sentencepiece_codec import digest

    return digest(table(spark, sf_dir, "documents"))


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausework.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))
