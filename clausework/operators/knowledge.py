"""Knowledge bases: entries from their files, lookup, terms in texts, search and compact context.

Entries: kb_id, entry_id, type, layer, name, aliases, keywords (normal forms, longest first), domain_tags, definition, metadata (map
of JSON values), ord (place in the order of the files). Texts meet entries on words, so a text is held only against entries that may match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import records, scalars
from clausework.operators import outline

# fixed values
KNOWN_KEYS = ("id", "name", "type", "layer", "aliases", "keywords", "domain_tags", "definition", "relations")
CONTEXT_KEYS = ("class_id", "attributes", "methods", "common_instances", "obis", "rules", "services", "suites", "states", "bits")
_WORD = r"[\p{L}\p{N}]"


def entries(files: DataFrame) -> DataFrame:
    """files: ord, stem, json (kb_id, layer, entries). Unknown keys of an entry go to metadata."""
    shape = "kb_id string, layer string, entries array<string>"
    f = files.select("ord", "stem", F.from_json("json", shape).alias("k")).select("ord", "stem", "k.kb_id", "k.layer", F.posexplode("k.entries").alias("pos", "raw"))
    known = "id string, name string, type string, layer string, aliases array<string>, keywords array<string>, domain_tags array<string>, definition string"
    f = f.withColumns({"e": F.from_json("raw", known), "m": F.from_json("raw", "map<string,string>")})
    none = F.array().cast("array<string>")
    name = scalars.clean(F.col("e.name"))
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    terms = F.transform(F.concat(F.array(name), F.coalesce("e.aliases", none), F.coalesce("e.keywords", none)), records.match_term)
    terms = F.array_distinct(F.filter(terms, lambda t: F.length(t) > 1))
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return f.select(
        given(F.col("kb_id"), F.col("stem")).alias("kb_id"),
        given(F.col("e.id"), name).alias("entry_id"),
        given(F.col("e.type"), F.lit("term")).alias("type"),
        given(F.col("e.layer"), given(F.col("layer"), F.lit("term"))).alias("layer"),
        name.alias("name"),
        F.transform(F.coalesce("e.aliases", none), scalars.clean).alias("aliases"),
        F.array_sort(terms, longest).alias("keywords"),
        F.coalesce("e.domain_tags", none).alias("domain_tags"),
        scalars.clean(F.col("e.definition")).alias("definition"),
        F.map_filter("m", lambda k, _: ~k.isin(*KNOWN_KEYS)).alias("metadata"),
        F.struct("ord", "pos").alias("ord"),
    )


def by_id(found: DataFrame) -> DataFrame:
    """entry_id, kb_id, name, collisions: the first entry of an id, and the bases that share it where several do."""
    g = found.groupBy("entry_id").agg(F.min_by(F.struct("kb_id", "name"), "ord").alias("e"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "kb_id"))), lambda x: x["kb_id"]).alias("kbs"))
    return g.select("entry_id", "e.kb_id", "e.name", F.when(F.size("kbs") > 1, F.col("kbs")).alias("collisions"))


def matched_terms(text: Column, terms: Column) -> Column:
    """Distinct terms found in a text in normal form, longest first at each place, whole words or plurals; in the order they stand."""
    any_term = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    # a border is asked for only where the term itself begins or ends with a letter or digit
    pattern = F.concat(F.lit(rf"(?:(?<![a-z0-9])|(?!{_WORD}))("), any_term, F.lit(rf")(?:e?s)?(?:(?![a-z0-9])|(?<!{_WORD}))"))
    return F.when(F.size(terms) > 0, F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def in_texts(texts: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """key, kb_id, entry_id, type, layer, name, terms (all, in order): entries with a term in the text."""
    low = texts.select(key, records.match_term(F.col(text)).alias("_text"))
    e = found.select(F.concat_ws("\x1f", "kb_id", "entry_id").alias("_id"), "kb_id", "entry_id", "type", "layer", "name", "keywords")
    terms = e.select("_id", F.explode("keywords").alias("_term"))
    near = outline.term_matches(low, "_text", terms, "_id", "_term").select(key, "_text", "_id").distinct()
    hit = near.join(e, "_id").withColumn("terms", matched_terms(F.col("_text"), F.col("keywords"))).where(F.size("terms") > 0)
    return hit.select(key, "kb_id", "entry_id", "type", "layer", "name", "terms")


def ranked(hits: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """hits with score (letters of all matched terms) and rank, best first, then by name; at most eight terms shown."""
    score = F.aggregate("terms", F.lit(0), lambda a, t: a + F.greatest(F.lit(1), F.length(t)))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "name", "kb_id", "entry_id")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("terms", F.slice("terms", 1, 8))


def search_scores(found: DataFrame, query: Column) -> DataFrame:
    """found with `score` and `terms` for a query (a text in normal form): 100 for the name, else 40 for a hit anywhere, and letters, thirty at
    most each, of terms in the query and of keywords that hold it or are held by it; entries without a score are left out."""
    none = F.array().cast("array<string>")
    all_text = records.match_term(F.concat_ws(" ", "name", "definition", "type", "layer", F.array_join("aliases", " "), F.array_join("keywords", " "), F.array_join("domain_tags", " ")))
    named, within = query == records.match_term(F.col("name")), F.size(matched_terms(all_text, F.array(query))) > 0
    own = matched_terms(query, F.col("keywords"))
    like = F.filter("keywords", lambda t: F.contains(t, query) | F.contains(query, t))
    letters = lambda xs: F.aggregate(xs, F.lit(0), lambda a, t: a + F.least(F.lit(30), F.length(t)))
    score = F.when(named, 100).when(within, 40).otherwise(0) + letters(own) + letters(like)
    first = F.when(named, F.array(F.col("name"))).when(within, F.array(query)).otherwise(none)
    out = found.withColumns({"score": F.when(query != "", score).otherwise(0), "terms": F.slice(F.array_distinct(F.concat(first, own, like)), 1, 8)})
    return out.where("score > 0")


def compact_metadata(metadata: Column) -> Column:
    """The keys of a metadata map that a context shows; lists to twelve members."""
    cut = lambda _, v: F.when(F.startswith(v, F.lit("[")), F.to_json(F.slice(F.from_json(v, "array<string>"), 1, 12))).otherwise(v)
    return F.transform_values(F.map_filter(metadata, lambda k, _: k.isin(*CONTEXT_KEYS)), cut)


def context(hits: DataFrame, found: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """key, rank, name, type, layer, definition, metadata: what a prompt shows of the best matches of each text."""
    top = ranked(hits, key, limit).select(key, "rank", "kb_id", "entry_id")
    return top.join(found, ["kb_id", "entry_id"]).select(key, "rank", "name", "type", "layer", "definition", compact_metadata(F.col("metadata")).alias("metadata"))


def compact_matches(hits: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """key, matches: up to twelve matches by type and name, with five terms each."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("type", "name", "kb_id", "entry_id"))
    top = hits.withColumn("i", i).where(F.col("i") <= limit)
    one = F.struct("i", "kb_id", "entry_id", "type", "name", F.slice("terms", 1, 5).alias("terms"))
    return top.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("matches"))


def domain_tags(hits: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, tags: the distinct tags of all matches in their order."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("type", "name", "kb_id", "entry_id"))
    t = hits.withColumn("i", i).join(found.select("kb_id", "entry_id", "domain_tags"), ["kb_id", "entry_id"])
    g = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "domain_tags"))).alias("s"))
    return g.select(key, F.array_distinct(F.flatten(F.transform("s", lambda x: x["domain_tags"]))).alias("tags"))


def coverage(found: DataFrame) -> DataFrame:
    """type, n of the entries."""
    return found.groupBy("type").agg(F.count("*").alias("n"))
