"""Queries over two small knowledge bases; the SQL holds their terms as literals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import knowledge as kb
from clausework.plans.clause_queries import CLAUSES, clauses
from clausework.sources.store import written

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

FILES = (
    ("one", {"kb_id": "K1", "layer": "core", "entries": [
        {"id": "event", "name": "Event", "aliases": ["event log"], "keywords": ["events"], "type": "object", "domain_tags": ["event", "log"], "definition": "what happens", "class_id": 7, "services": list(range(15)), "note": "x"},
        {"id": "profile", "name": "Load profile", "keywords": ["profile"], "type": "data_profile", "domain_tags": ["load_profile"], "definition": "a  curve"},
        {"name": "OBIS", "type": "code_system", "layer": "code", "domain_tags": ["code", "event"]},
    ]}),
    ("two", {"entries": [
        {"id": "event", "name": "Incident", "keywords": ["power failure"]},
        {"id": "cap", "name": "采集", "aliases": ["c"], "type": "function", "domain_tags": ["data"]},
        {"id": "meter", "name": "Meter", "keywords": ["meter clock"], "type": "object", "domain_tags": ["meter"]},
    ]}),
)


def _entries(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame([(i, stem, json.dumps(body, ensure_ascii=False)) for i, (stem, body) in enumerate(FILES)], "ord int, stem string, json string")
    return kb.entries(files)


#: kb, entry, type, layer, name, keywords (longest first), tags.
_E = """(VALUES ('K1', 'event', 'object', 'core', 'Event', 'event log|events|event', 'event|log'), ('K1', 'profile', 'data_profile', 'core', 'Load profile', 'load profile|profile', 'load_profile'),
('K1', 'OBIS', 'code_system', 'code', 'OBIS', 'obis', 'code|event'), ('two', 'event', 'term', 'term', 'Incident', 'power failure|incident', ''), ('two', 'cap', 'function', 'term', '采集', '采集', 'data'),
('two', 'meter', 'object', 'term', 'Meter', 'meter clock|meter', 'meter')) e(kb_id, entry_id, type, layer, name, keywords, tags)"""
_LOW = "replace(' ' || lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) || ' ', ' ', '  ')"
_FOUND = rf"list_filter(regexp_extract_all({_LOW}, '(?:^|[^a-z0-9])(' || replace(replace(keywords, ' ', '  '), '|', '|') || ')(?:e?s)?(?:$|[^a-z0-9])', 1), lambda x: true)"
_HITS = f"(SELECT id, kb_id, entry_id, type, layer, name, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS ts FROM (SELECT id, kb_id, entry_id, type, layer, name, list_transform({_FOUND}, lambda x: replace(x, '  ', ' ')) AS ts FROM {CLAUSES} c, {_E}) WHERE len(ts) > 0)"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_query(f"SELECT kb_id, entry_id, type, layer, name, keywords, tags, CASE WHEN kb_id = 'K1' AND entry_id = 'event' THEN 'class_id,note,services' ELSE '' END AS metadata FROM {_E}")
def knowledge_entries(spark, d):
    return _entries(spark).select("kb_id", "entry_id", "type", "layer", "name", F.array_join("keywords", "|").alias("keywords"), F.array_join("domain_tags", "|").alias("tags"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata"))


@_query(f"SELECT entry_id, arg_min(kb_id, kb_id = 'two') AS kb_id, arg_min(name, kb_id = 'two') AS name, CASE WHEN count(*) > 1 THEN 'K1,two' END AS collisions FROM {_E} GROUP BY 1")
def knowledge_by_id(spark, d):
    return kb.by_id(_entries(spark)).withColumn("collisions", F.array_join("collisions", ","))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return written(kb.in_texts(clauses(spark, d), _entries(spark), "id", "s"), "hits")


@_query(f"SELECT id, kb_id, entry_id, array_to_string(ts, '|') AS terms FROM {_HITS}")
def knowledge_in_texts(spark, d):
    return _hits(spark, d).select("id", "kb_id", "entry_id", F.array_join("terms", "|").alias("terms"))


@_query(f"SELECT id, name, CAST(list_sum(list_transform(ts, lambda t: length(t))) AS INT) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(ts, lambda t: length(t))) DESC, name, kb_id, entry_id) AS INT) AS rank FROM {_HITS} QUALIFY rank <= 2")
def knowledge_ranked(spark, d):
    return kb.ranked(_hits(spark, d), "id", 2).select("id", "name", "score", "rank")


@_query(f"SELECT id, CAST(rank AS INT) AS rank, name, CASE WHEN kb_id = 'K1' AND entry_id = 'event' THEN '7 12' ELSE '' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_sum(list_transform(ts, lambda t: length(t))) DESC, name, kb_id, entry_id) AS rank FROM {_HITS})")
def knowledge_context(spark, d):
    c = kb.context(_hits(spark, d), _entries(spark), "id")
    n = F.size(F.from_json(F.try_element_at("metadata", F.lit("services")), "array<string>"))
    return c.select("id", "rank", "name", F.when(F.map_contains_key("metadata", "class_id"), F.concat_ws(" ", F.try_element_at("metadata", F.lit("class_id")), n.cast("string"))).otherwise("").alias("shown"))


@_query(f"SELECT id, CAST(least(12, count(*)) AS INT) AS n, arg_min(name, type || name || kb_id) AS first FROM {_HITS} GROUP BY 1")
def knowledge_compact(spark, d):
    return kb.compact_matches(_hits(spark, d), "id").select("id", F.size("matches").alias("n"), F.get("matches", F.lit(0))["name"].alias("first"))


@_query(f"""WITH t AS (SELECT id, string_agg(tags, '|' ORDER BY type, name) AS all_tags FROM (SELECT h.id, h.type, h.name, e.tags FROM {_HITS} h JOIN {_E} ON h.kb_id = e.kb_id AND h.entry_id = e.entry_id) WHERE tags <> '' GROUP BY 1),
a AS (SELECT DISTINCT id FROM {_HITS}) SELECT a.id, coalesce(array_to_string(list_filter(string_split(all_tags, '|'), lambda x, i: list_position(string_split(all_tags, '|'), x) = i), ','), '') AS tags FROM a LEFT JOIN t USING (id)""")
def knowledge_tags(spark, d):
    return kb.domain_tags(_hits(spark, d), _entries(spark), "id").select("id", F.array_join("tags", ",").alias("tags"))


@_query("SELECT * FROM (VALUES ('event', 'Event', 100 + 5 + (9 + 6 + 5)), ('event', 'OBIS', 40), ('meter clock', 'Meter', 40 + 11 + (11 + 5)), ('采集', '采集', 100 + 2 + 2)) v(query, name, score)")
def knowledge_search(spark, d):
    out = None
    for q in ("event", "meter clock", "采集"):
        x = kb.search_scores(_entries(spark), F.lit(q)).select(F.lit(q).alias("query"), "name", "score")
        out = x if out is None else out.unionByName(x)
    return out


@_query(f"SELECT type, count(*) AS n FROM {_E} GROUP BY 1")
def knowledge_coverage(spark, d):
    return kb.coverage(_entries(spark))
