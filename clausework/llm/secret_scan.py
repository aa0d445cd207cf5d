r"""Secret scans: a random forest that removes false positives from candidate findings; DataFrame expressions only.

Candidates are all runs of at least MIN_LENGTH characters of [A-Za-z0-9+/_.-] that hold a digit, or that stand right of an assignment;
"=" parts a key from its value. Left of a run stand the run and the signs before it in its word, or the two words before.
Features, of each occurrence: length, shares of digits, upper case and hexadecimal, character-class transitions, dictionary coverage (letters of
the candidate in parts that at least DICTIONARY_DOCS distinct texts, and one of DICTIONARY_SHARE, use as words outside candidates), a path-like shape, depth of the document's path, and the
neighbouring words (an assignment sign or a credential word before, quotes around).

The forest is trained on labelled findings: a table of the caller, or, where none is given, examples() - EXAMPLES short texts made by a
seeded rule, in which random secrets stand in the places of secrets, and commit ids, checksums, identifiers, card numbers, hosts, paths, dates and
placeholders of common words of the corpus (counted over all distinct texts) stand in theirs or in the same places. Their labels say how a value was made; the forest sees
its features alone. The training set is the first TRAIN_ROWS of each label by a hash (the documented bound). Dictionary counts
cover all distinct texts.

Defined results. Null or empty texts have no candidates. A candidate of a document comes out once, with its number, and with the highest
probability of its occurrences. With no labelled findings, or one label only, probability is that label's share (0.5 for none). A null path
has depth 0; a null id is an id of its own. Texts are taken whole whatever their length. Extra columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm._store import materialise

MIN_LENGTH = 8
TRAIN_ROWS = 5_000
#: Made findings, and the common words in them.
EXAMPLES, EXAMPLE_WORDS = 8_000, 200
DICTIONARY_DOCS = 3
DICTIONARY_SHARE = 1_000
TREES, DEPTH, SEED = 30, 8, 11
#: Candidate parts (16 bytes each) that may be broadcast into the dictionary count; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_SIGN = "A-Za-z0-9+/_.-"
_RUN = rf"[{_SIGN}]{{{MIN_LENGTH},}}"
#: Runs that hold a digit or stand right of an assignment, so words of candidates.
_TAKEN = rf"(?<![{_SIGN}])(?=[A-Za-z+/_.-]*+[0-9]){_RUN}|[=:]\s?[\"']?{_RUN}"
_CREDENTIAL = r"(?i)(token|secret|passw|pwd|api|auth|cred|key|bearer)"
FEATURES = ["f_length", "f_digit", "f_upper", "f_hex", "f_change", "f_variety", "f_dictionary", "f_path", "f_depth", "f_assign", "f_credential", "f_quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, before, quoted, value, n: distinct occurrences of the candidates of each document with what stands before."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("t"))
    words = F.split("t", r"[\x20\x09-\x0D]+")
    d = d.where(F.col("t").rlike(_RUN)).select("doc_id", "path", words.alias("ws"))
    d = d.select("doc_id", "path", "ws", F.posexplode("ws").alias("at", "word")).where(F.length("word") >= MIN_LENGTH)
    near = lambda k: F.coalesce(F.get("ws", F.col("at") - k), F.lit(""))
    # runs of any length and the signs before each
    tokens = [F.regexp_extract_all("word", F.lit(rf"([^{_SIGN}]*+)([{_SIGN}]++)"), F.lit(g)) for g in (1, 2)]
    d = d.where(F.col("word").rlike(_RUN)).select("doc_id", "path", "word", near(2).alias("w2"), near(1).alias("w1"), tokens[0].alias("signs"), tokens[1].alias("runs"))

    def token(value: Column, i: Column) -> Column:
        left = F.when(i == 0, F.concat_ws(" ", "w2", "w1", F.get("signs", i))).otherwise(F.concat(F.get("runs", i - 1), F.get("signs", i)))
        return F.struct(F.regexp_replace(value, r"^[.-]+|[.-]+$", "").alias("value"), left.alias("before"))

    found = F.filter(F.transform("runs", token), lambda x: F.length(x["value"]) >= MIN_LENGTH)
    d = d.select("doc_id", "path", F.col("word").contains('"').alias("quoted"), F.explode(found).alias("x")).select("doc_id", "path", "quoted", "x.value", "x.before")
    d = d.where(F.col("value").rlike("[0-9]") | F.col("before").rlike(r"[=:][\"']?$|[=:] [\"']?$"))
    return d.groupBy("doc_id", "path", "before", "quoted", "value").agg(F.count("*").alias("n"))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def features(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """found with the columns FEATURES."""
    parts = found.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("part")).where(F.length("part") >= 3)
    parts = materialise(parts.distinct(), "parts")
    wanted = parts.select("part").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64(f"`{text_col}`").alias("tid"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    least = F.greatest(F.lit(DICTIONARY_DOCS), F.lit(texts.select("tid").distinct().count() // DICTIONARY_SHARE))
    words = texts.select("tid", F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("t", _TAKEN, " ")), "[^a-z]+"))).alias("part")).where(F.length("part") >= 3)
    known = words.join(wanted, "part").distinct().groupBy("part").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    cover = parts.join(known, "part").groupBy("value").agg(F.sum(F.length("part")).alias("covered"))
    lower = F.regexp_replace("value", "[a-z]", "a")
    kinds = F.regexp_replace(F.regexp_replace(lower, "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    n = F.length("value")
    out = found.join(cover, "value", "left")
    return out.withColumns(
        {
            "f_length": n.cast("double"),
            "f_digit": _share("[^0-9]"),
            "f_upper": _share("[^A-Z]"),
            "f_hex": _share("[^0-9a-fA-F]"),
            "f_change": (F.length(runs) - 1) / n,
            "f_variety": F.size(F.array_distinct(F.split("value", ""))) / F.least(n, F.lit(40)),
            "f_dictionary": F.coalesce(F.col("covered"), F.lit(0)) / n,
            "f_path": (n - F.length(F.translate("value", "/.", ""))).cast("double"),
            "f_depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
            "f_assign": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "f_credential": F.col("before").rlike(_CREDENTIAL).cast("double"),
            "f_quoted": F.col("quoted").cast("double"),
        }
    ).drop("covered")


#: Where a made finding stands; {V} is its value.
_PLACES = {
    "secret": ['token = "{V}"', "api_key: {V}", "SECRET={V}", "password = '{V}'", "Authorization: Bearer {V}", '{"auth_token":"{V}"}', "export ACCESS_KEY={V}", "client_secret: {V}"],
    "plain": ["commit {V}", "sha1 {V}", 'checksum = "{V}"', "md5: {V}", 'id = "{V}"', "etag: {V}", "file {V}", "see {V}", "order {V}", "version: {V}", "was {V}", "{V}"],
    "price": ["card {V}", "order {V}", "was {V}", "number: {V}", "{V}", "phone {V}", 'id = "{V}"'],
}
#: (place, kind of value, label)
_MADE = [("secret", x, 1.0) for x in ("hex32", "hex40", "hex64", "HEX40", "base64", "mixed24", "upper20", "mixed40", "mixed12")]
_MADE += [("plain", x, 0.0) for x in ("hex32", "hex40", "hex64", "HEX40", "base64", "uuid", "mixed24")]
_MADE += [("price", x, 0.0) for x in ("digits16", "digits9", "date", "decimal")]
_MADE += [(x, y, 0.0) for x in ("plain", "secret") for y in ("readable", "host", "path", "release", "date", "word")]


def _made(words: list[str], seed: int) -> dict[str, Column]:
    """Values by kind, of column id."""
    h = lambda j: F.sha2(F.concat(F.lit(f"{seed}/{j}/"), F.col("id").cast("string")), 256)
    number = lambda j, n: F.pmod(F.conv(F.substring(h(j), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    word = lambda j: F.element_at(F.array(*map(F.lit, words)), number(j, len(words)) + 1)
    base = F.translate(F.base64(F.unhex(F.concat(h(1), h(2)))), "=", "")
    mixed = F.regexp_replace(base, "[+/]", "x")
    digits = F.translate(h(3), "abcdef", "012345")
    date = F.concat_ws("-", number(4, 40) + 1990, F.lpad((number(5, 12) + 1).cast("string"), 2, "0"), F.lpad((number(6, 28) + 1).cast("string"), 2, "0"))
    return {
        "hex32": F.substring(h(1), 1, 32),
        "hex40": F.substring(h(1), 1, 40),
        "hex64": h(1),
        "HEX40": F.upper(F.substring(h(1), 1, 40)),
        "base64": F.concat(F.substring(base, 1, 42), F.lit("x")),
        "mixed12": F.concat(F.substring(mixed, 1, 11), F.substring(digits, 1, 1)),
        "mixed24": F.concat(F.substring(mixed, 1, 23), F.substring(digits, 1, 1)),
        "mixed40": F.concat(word(7), F.lit("_"), F.substring(mixed, 1, 36), F.substring(digits, 1, 1)),
        "upper20": F.concat(F.upper(F.substring(mixed, 1, 19)), F.substring(digits, 1, 1)),
        "uuid": F.concat_ws("-", *(F.substring(h(1), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "digits16": F.substring(digits, 1, 16),
        "digits9": F.substring(digits, 1, 9),
        "date": date,
        "decimal": F.concat_ws(".", F.substring(digits, 1, 7), F.substring(digits, 8, 2)),
        "readable": F.concat_ws("-", word(7), word(8), word(9), number(4, 3000)),
        "host": F.concat(word(7), number(4, 90), F.lit("."), word(8), F.lit(".example.com")),
        "path": F.concat_ws("/", F.lit("/usr"), word(7), word(8), F.concat(word(9), number(4, 90), F.lit(".html"))),
        "release": F.concat(word(7), F.lit("-"), number(4, 30), F.lit("."), number(5, 30), F.lit("."), number(6, 30), F.lit("-x86_64")),
        "word": F.concat(word(7), word(8), word(9), F.lit("s")),
    }


def examples(docs: DataFrame, rows: int = EXAMPLES, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """doc_id, source, text, value, label: made findings amid common words of the corpus."""
    # counted over all distinct texts: each is dealt once by its hash, so that only counts of words are shuffled after that
    texts = docs.select(F.xxhash64(f"`{text_col}`").alias("tid"), F.col(f"`{text_col}`").alias("t")).where("t is not null").dropDuplicates(["tid"])
    parts = texts.select(F.explode(F.array_distinct(F.split(F.lower("t"), "[^a-z]+"))).alias("part")).where("length(part) between 3 and 12")
    common = parts.groupBy("part").count().orderBy(F.desc("count"), "part").limit(EXAMPLE_WORDS)
    words = [r["part"] for r in common.collect()] or ["word"]  # EXAMPLE_WORDS at most
    places = [(p, kind, label) for place, kind, label in _MADE for p in _PLACES[place]]
    at = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(places))).cast("int") + 1
    made = _made(words, seed)
    value = F.element_at(F.create_map(*(x for kind, v in made.items() for x in (F.lit(kind), v))), F.col("p.kind"))
    d = docs.sparkSession.range(rows).withColumn("p", F.element_at(F.array(*(F.struct(F.lit(t).alias("text"), F.lit(kind).alias("kind"), F.lit(y).alias("label")) for t, kind, y in places)), at))
    said = lambda j: F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(len(words))).cast("int") + 1)
    path = F.element_at(F.array(*map(F.lit, ("web", "a/b.py", "docs/readme.md", "conf/prod/x.env"))), F.pmod("id", F.lit(4)).cast("int") + 1)
    d = d.select(F.concat(F.lit("example-"), F.col("id").cast("string")).alias("doc_id"), path.alias("source"), value.alias("value"), F.col("p.label").alias("label"), F.col("p.text").alias("place"), said(1).alias("a"), said(2).alias("b"), said(3).alias("c"))
    return d.select("doc_id", "source", F.concat_ws(" ", "a", "b", F.replace("place", F.lit("{V}"), "value"), "c").alias("text"), "value", "label")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, value_sha256, n_times, n_chars, probability, is_secret. findings: (doc_id, value, label), label 1 for a secret."""
    found = verdicts(docs, findings, id_col, text_col, path_col).groupBy("doc_id", "value").agg(F.max("p").alias("p"), F.sum("n").alias("n"))
    return found.select("doc_id", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.col("n").alias("n_times"), F.length("value").alias("n_chars"), F.round("p", 6).alias("probability"), (F.col("p") >= 0.5).alias("is_secret"))


def verdicts(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", seen: DataFrame | None = None) -> DataFrame:
    """The occurrences of all candidates with their features and probability p. seen: other texts with the columns of docs to judge instead."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    judged = candidates(docs if seen is None else seen, id_col, text_col, path_col).withColumn("label", F.lit(None).cast("double"))
    if findings is None:
        made = materialise(examples(docs, text_col=text_col), "examples")
        known = candidates(made).join(made.select("doc_id", "value", "label"), ["doc_id", "value"]).withColumn("doc_id", F.lit(None).cast(judged.schema["doc_id"].dataType))
        both = judged.unionByName(known)
    else:
        labels = findings.select(F.col("doc_id").alias("lid"), F.col("value").alias("lv"), F.col("label").cast("double").alias("y")).distinct()
        own = candidates(docs, id_col, text_col, path_col) if seen is not None else judged.drop("label")
        known = own.join(labels, own["doc_id"].eqNullSafe(F.col("lid")) & (F.col("value") == F.col("lv"))).select(*own.columns, F.col("y").alias("label"))
        both = judged.unionByName(known)
    # dictionary coverage is counted once, for what is judged and what is learnt from
    found = materialise(features(materialise(both, "candidates"), docs, id_col, text_col), "features")
    # one row for equal features, so that no group of copies outweighs the rest
    labelled = found.where("label is not null").dropDuplicates(["value", "before", "path", "quoted", "label"])
    one = lambda y: labelled.where(F.col("label") == y).orderBy(F.xxhash64("value", "before"), "value", "before", "path", "quoted").limit(TRAIN_ROWS)
    chosen = materialise(one(1.0).unionByName(one(0.0)).select("label", *FEATURES), "training")
    seen_labels = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    found = found.where("label is null")
    if len(seen_labels) < 2:
        return found.withColumn("p", F.lit(next(iter(seen_labels), 0.5)))
    wide = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(wide.transform(chosen))
    return forest.transform(wide.transform(found)).withColumn("p", vector_to_array("probability")[1])
