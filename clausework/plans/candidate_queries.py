"""Queries over candidate rules; every part stands for a table row of one of twelve shapes, and the SQL states what must come of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import candidates
from clausework.plans.clause_queries import CLAUSES, clauses

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

#: Fields of a row by part number modulo 12; {z} is the part's size.
SHAPES = (
    (("#", "{z}"), ("Object/attribute name", "Clock"), ("CL", "8"), ("Value", "0-0:1.0.{z}.255")),
    (("#", "2"), ("Object/attribute name", "time"), ("Access rights RC/PC/SC/LC", "R/W/--/-")),
    (("Group number", "{z}"), ("Subgroup number", ""), ("Event number", "seven"), ("Description of the event", "lid may be open")),
    (("Group number", "1"), ("Subgroup number", "{z}"), ("Minimum records", "10"), ("Event subgroup description", "power")),
    (("ID", "{z}"), ("Name", "Suite {z}")),
    (("bit", "{z}"), ("Security Policy - Security States", "reserved")),
    (("State", "{z}"), ("Security policy", "none")),
    (("Greatness", "Energy"), ("Greatness_2", "Active {z}"), ("Unit", "kWh")),
    (("Flag", "F{z}"), ("Description", "it shall be set")),
    (("Function", "Log {z}"), ("Limit", "{z} A"), ("Mode", "HLS"), ("Note", "old"), ("Status", "x")),
    (("Event", "Lid"), ("Number of event", "{z}"), ("Event description", "lid")),
    (("Function", "plain"), ("Limit", "")),
)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    maps = F.array(*(F.create_map(*(F.lit(x) for pair in s for x in pair)) for s in SHAPES))
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", F.element_at(maps, (F.col("p_partkey") % 12 + 1).cast("int")).alias("m"))
    fields = F.transform_values("m", lambda _, v: F.replace(v, F.lit("{z}"), F.col("p_size").cast("string")))
    title = F.when(F.col("p_partkey") % 12 == 4, "Security suites").when(F.col("p_partkey") % 24 == 10, "Events").when(F.col("p_partkey") % 12 == 8, "Flags").otherwise("Things")
    # twelve rows make a table, so that the object of the first row stands above the second
    table = F.floor(F.col("p_partkey") / 12)
    items = p.select(F.concat(F.lit("I"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("item_id"), F.concat(F.lit("B"), table.cast("string")).alias("block_id"), title.alias("title"), (F.col("p_partkey") % 12).alias("row_index"), fields.alias("fields"), F.array().cast("array<string>").alias("tags"))
    return candidates.object_above(items, ["block_id"])


_Z = "(SELECT p_partkey AS id, 'I' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS item, CAST(p_size AS VARCHAR) AS z, p_partkey % 12 AS k, lag(CAST(p_size AS VARCHAR)) OVER (ORDER BY p_partkey) AS above FROM part)"
#: (shape, position, type, requirement in SQL, confidence)
_WANT = [
    (0, 0, "cosem_object_instance", "'COSEM object Clock / CL 8 / OBIS 0-0:1.0.' || z || '.255 shall be defined by the profile.'", 0.88),
    (1, 0, "cosem_attribute_access", "CASE WHEN above IS NULL THEN 'COSEM attribute time shall use access rights R/W/--/-.' ELSE 'COSEM attribute Clock.time for Clock / CL 8 / OBIS 0-0:1.0.' || above || '.255 shall use access rights R/W/--/-.' END", None),
    (2, 0, "event_definition", "'Event G' || z || '-SG?-Eseven shall be defined as: lid may be open.'", 0.84),
    (3, 0, "event_group_retention", "'Event subgroup G1-SG' || z || ' shall keep at least 10 records for power.'", 0.86),
    (4, 0, "security_suite_definition", "'Security suite ' || z || ' shall be defined as Suite ' || z || '.'", 0.86),
    (5, 0, "security_policy_bit", "'Security policy bit ' || z || ' shall be defined as: reserved.'", 0.86),
    (6, 0, "security_policy_state", "'Security policy state ' || z || ' shall be defined as: none.'", 0.84),
    (7, 0, "measurement_quantity_unit", "'Measurement quantity Active ' || z || ' shall use unit kWh.'", 0.82),
    (8, 0, "flag_definition", "'Flags: F' || z || ' shall be defined as: it shall be set.'", 0.8),
    (8, 1, "functional", "'F' || z || ' | it shall be set'", 0.74),
    (9, 0, "table_value_matrix", "'Log ' || z || ' shall have Limit set to ' || z || ' A.'", 0.8),
    (9, 1, "association_security_matrix", "'Log ' || z || ' shall have Mode set to HLS.'", 0.8),
    (10, 0, "event_definition", "'Event G?-SG?-E' || z || ' shall be defined as: lid.'", 0.84),
]


def _expected() -> str:
    parts = [f"SELECT id, item AS source_id, {pos} AS pos, '{kind}' AS requirement_type, {text} AS requirement, {'CASE WHEN above IS NULL THEN 0.82 ELSE 0.9 END' if conf is None else conf} AS confidence FROM {_Z} WHERE k = {k}{' AND id % 24 = 10' if k == 10 else ''}" for k, pos, kind, text, conf in _WANT]
    return " UNION ALL ".join(parts)


QUERIES["row_candidates"] = lambda spark, d: candidates.of_rows(_rows(spark, d)).select("source_id", F.col("pos").cast("long").alias("pos"), "requirement_type", "requirement", "confidence")
ORACLE["row_candidates"] = f"SELECT source_id, CAST(pos AS BIGINT) AS pos, requirement_type, requirement, CAST(confidence AS DOUBLE) AS confidence FROM ({_expected()})"


def atomic_requirements(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.of_rows(_rows(spark, d))
    return candidates.union([rows, rows]).select("req_id", "stable_req_id", "source_id", "requirement_type")


QUERIES["atomic_requirements"] = atomic_requirements
ORACLE["atomic_requirements"] = f"""SELECT 'AREQ-' || lpad(CAST(row_number() OVER (ORDER BY source_id, pos) AS VARCHAR), CAST(greatest(6, length(CAST(row_number() OVER (ORDER BY source_id, pos) AS VARCHAR))) AS INTEGER), '0') AS req_id,
 'SREQ-' || upper(substr(sha256(source_id || chr(10) || requirement_type || chr(10) || lower(requirement)), 1, 16)) AS stable_req_id, source_id, requirement_type FROM ({_expected()})"""


def paragraph_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = clauses(spark, d).select(F.col("id").cast("string").alias("block_id"), F.concat(F.lit("If the lid is open; "), "s", F.lit(" End.")).alias("text"), F.array().cast("array<string>").alias("tags"))
    return candidates.of_paragraphs(c).select("source_id", "requirement", "condition", "ambiguity", "requirement_type")


QUERIES["paragraph_candidates"] = paragraph_candidates
ORACLE["paragraph_candidates"] = rf"""WITH c AS (SELECT id, trim(regexp_replace('If the lid is open; ' || replace(s, '…', '...') || ' End.', '\s+', ' ', 'g')) AS t FROM {CLAUSES}),
p AS (SELECT id, list_filter(string_split(regexp_replace(t, '([.;!?]) ', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x) <> '') AS ps FROM c),
u AS (SELECT id, unnest(ps) AS s, unnest(list_prepend(NULL, ps[:-2])) AS prev FROM p)
SELECT CAST(id AS VARCHAR) AS source_id, s AS requirement, CASE WHEN prev = 'If the lid is open;' THEN prev END AS condition,
 regexp_matches(lower(s), 'if necessary|can be|may be|where applicable|reserved') AS ambiguity,
 CASE WHEN regexp_matches(lower(s), 'hls|lls|password|encrypt|authenticat') THEN 'security' WHEN regexp_matches(lower(s), 'read|write|access|association') THEN 'access_control'
 WHEN regexp_matches(lower(s), 'dlms|communication|push') THEN 'communication' WHEN regexp_matches(lower(s), 'cosem|obis|logical_name|attribute') THEN 'cosem_object' ELSE 'functional' END AS requirement_type
FROM u WHERE regexp_matches(lower(s), 'shall|must|is required|are required|mandatory|required by|required for|set to')"""


def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    c = clauses(spark, d)
    tags = lambda n: F.when(F.col("id") % n == 0, F.array(F.lit("event"))).otherwise(F.array().cast("array<string>"))
    key = lambda p: F.concat(F.lit(p), F.lpad(F.col("id").cast("string"), 7, "0"))
    chunks = c.select(key("C").alias("chunk_id"), (F.col("id") % 5 == 0).alias("requirement_like"), tags(7).alias("tags"))
    return candidates.tasks(chunks, c.select(key("I").alias("item_id"), (F.col("id") % 3 == 0).alias("requirement_like"), tags(11).alias("tags")))


QUERIES["review_tasks"] = review_tasks
ORACLE["review_tasks"] = """WITH u AS (SELECT 0 AS src, 'extract_atomic_requirements' AS task_type, 'C' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS source_id FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0
UNION ALL SELECT 1, 'classify_table_atom', 'I' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 11 = 0), n AS (SELECT *, CAST(row_number() OVER (ORDER BY src, source_id) AS VARCHAR) AS i FROM u)
SELECT 'TASK-' || lpad(i, CAST(greatest(6, length(i)) AS INTEGER), '0') AS task_id, task_type, source_id FROM n"""


def cell_candidates(spark: SparkSession, d: str) -> DataFrame:
    from clausework.plans import table_queries as tq

    x = tq._all(spark, d)
    items = tq.tables.cell_items(tq._planned(x), x["cells"], x["rows"], x["ranges"], ["t"], F.concat(F.lit("T"), F.col("t").cast("string")))
    axes = x["dims"].select("t", "c", F.lit(True).alias("axis"))
    c = items.join(tq.tables._dealt(axes), ["t", "c"], "left").withColumns({"axis": F.coalesce("axis", F.lit(False)), "tags": F.array().cast("array<string>"), "context": F.col("row_header_context")})
    return candidates.of_cells(c).groupBy("requirement_type", "requirement").agg(F.count("*").alias("n"))


QUERIES["cell_candidates"] = cell_candidates
ORACLE["cell_candidates"] = """WITH p AS (SELECT p_partkey % 8 AS k, CAST(p_size AS VARCHAR) AS z FROM part),
u AS (SELECT 'capability_matrix' AS t, unnest(['Clock shall support GET.', 'Clock shall support SET.', 'Meter ' || z || ' shall support GET.', 'Meter ' || z || ' shall support GET.', 'Meter ' || z || ' shall support SET.', 'Relay shall support GET.']) AS r FROM p WHERE k = 1
UNION ALL SELECT 'functional', 'It must hold ' || z || ' cups' FROM p WHERE k = 4
UNION ALL SELECT 'functional', 'The box must fit' FROM p WHERE k = 2
UNION ALL SELECT 'functional', 'The device shall keep every record of kind ' || z || ' for at least ' || z || ' days.' FROM p, range(8) WHERE k = 2
UNION ALL SELECT 'functional', 'The lid must close. The lid shall lock.' FROM p WHERE k = 0)
SELECT t AS requirement_type, r AS requirement, count(*) AS n FROM u GROUP BY 1, 2"""
