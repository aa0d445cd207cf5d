r"""Benchmark decontamination with SimHash windows and a multi-index Hamming search; DataFrame expressions only.

Words are lower-cased runs of letters and digits. A window of a document has as many words as the item it is held against.
Windows are laid, at any start, where the shingles they share with an item of their size weigh at least THRESHOLD of all of the
item's. That loses none: the similarity is at most that share, so no other window can reach the threshold. Each window gets a
64-bit SimHash over its shingles and is then looked up by its size and fingerprint alone: RADIUS + 1 blocks of the
fingerprint index the items, and by the pigeonhole principle a pair within RADIUS bits agrees in a block. Pairs within the
radius are verified by exact weighted similarity: the weight of the common shingles over the weight of all, a shingle of c
item texts weighing 1 / c and one of none 1. RADIUS lies more than four standard deviations above the expected
distance at the threshold.

Defined results. Null or empty texts and items match nothing. Items of fewer than K words are one whole shingle, so an item of one
word is found wherever the word is. Repeated rows are reported once per id; a null id is an id of its own. An item id may come with
several texts, each of which is looked for. Ties: the best similarity, then the first window. Texts are taken whole whatever
their length. Extra columns, whatever their names, are ignored, and kept by decontaminated(). Empty tables give an empty
result, and without items all documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm._store import materialise

K = 5
THRESHOLD = 0.8
RADIUS = 22
#: Shingles of items (24 bytes each), or windows (32 bytes), that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


def shingles(words: str, k: int) -> Column:
    """Hashes of k consecutive words of the column `words` of word hashes; k is the item's shingle length, below K for short items only."""
    ahead = lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k)))
    return F.slice(F.transform(words, ahead), 1, F.greatest(F.size(words) - k + 1, F.lit(0)))


def _shingles_by(words: str, k: str) -> Column:
    """shingles() where k is a column of 1 to K."""
    out = shingles(words, K)
    for j in range(1, K):
        out = F.when(F.col(k) == j, shingles(words, j)).otherwise(out)
    return out


def simhash(hashes: str) -> Column:
    """64-bit SimHash of a column of hashes: bit b is set where more than half of the hashes have it.

    Sixteen sums hold four counters of 16 bits each, so a hash is added sixteen times and not sixty-four; longer arrays are summed in runs.
    """
    run = 1 << 15
    lanes = lambda part, j: F.aggregate(part, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0001000100010001)))
    n = F.size(hashes)

    def ones(j: int, k: int) -> Column:
        count = lambda acc: F.shiftrightunsigned(acc, 16 * k).bitwiseAND(F.lit(0xFFFF))
        runs = F.transform(F.sequence(F.lit(0), (n / run).cast("int")), lambda i: count(lanes(F.slice(hashes, i * run + 1, run), j)))
        return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x)

    def bits(acc: Column, j: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(4):
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), j + 16 * k)
            out = out.bitwiseOR(F.when(2 * F.shiftrightunsigned(acc, 16 * k).bitwiseAND(F.lit(0xFFFF)) > n, mask).otherwise(F.lit(0).cast("long")))
        return out

    both = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    short = both(F.transform(F.array(*(lanes(F.col(hashes), j) for j in range(16))), bits))
    one = lambda j, k: F.when(2 * ones(j, k) > n, F.lit((1 << (j + 16 * k)) - ((1 << 64) if j + 16 * k == 63 else 0))).otherwise(F.lit(0).cast("long"))
    return F.when(n <= run, short).otherwise(both(F.array(*(one(j, k) for j in range(16) for k in range(4)))))


def blocks(fp: Column) -> Column:
    """(block number, bits) for RADIUS + 1 blocks that cover the 64 bits."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _starts(hits: Column, n: Column, k: Column, last: Column, least: Column) -> Column:
    """Starts up to `last` of the windows whose distinct hits (pos, prev, w; by pos) weigh `least` or more. prev: where the shingle was before."""
    span = n - k
    weight = lambda i, s: F.aggregate(F.slice(hits, i + 1, span + 1), F.lit(0.0), lambda t, x: t + F.when((x["pos"] <= s + span) & (x["prev"] < s), x["w"]).otherwise(0.0))

    def led(i: Column) -> Column:
        """Windows whose first hit is number i; the one that starts with it has all hits of the others."""
        p = F.get(hits, i)["pos"]
        low, high = F.greatest(F.coalesce(F.get(hits, i - 1)["pos"] + 1, F.lit(0)), p - span), F.least(p, last)
        return F.when((low <= high) & (weight(i, p) >= least), F.filter(F.sequence(low, F.greatest(low, high)), lambda s: weight(i, s) >= least)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - 1), led))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame | None:
    """doc_id, tid, item_id, start, n, similarity: the best window of each row's text and item; None if there are no items."""
    named = items.select(F.col(f"`{item_col}`").alias("item_id"), hashes_of(F.col(f"`{item_text}`")).alias("ws")).where("size(ws) > 0").withColumn("item", F.xxhash64("ws"))
    it = named.select("item", "ws").dropDuplicates(["item"])  # an id may come with several texts, and a text with several ids
    it = it.withColumn("n", F.size("ws")).withColumn("k", F.least(F.lit(K), "n")).withColumn("sh", _shingles_by("ws", "k"))
    it = materialise(it.select("item", "n", "k", "sh"), "items")
    weight = it.select("item", F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg((F.lit(1.0) / F.count("*")).alias("w"))
    weighted = it.select("item", F.explode(F.array_distinct("sh")).alias("h")).join(weight, "h").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("own"), F.sum("w").alias("total"))
    prints = materialise(it.join(weighted, "item").select("item", "n", "k", "own", "total", simhash("sh").alias("fp")), "prints")
    places = materialise(it.select("item", "n", "k", F.explode(F.array_distinct("sh")).alias("h")).join(weight, "h").join(weighted.select("item", "total"), "item"), "places")
    lengths = [r["k"] for r in it.select("k").distinct().collect()]  # at most K values
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tid"), hashes_of(F.col(f"`{text_col}`")).alias("ws"))
    small = _small(places)
    found = None
    for k in lengths:
        hit = d.select("doc_id", "tid", F.size("ws").alias("dn"), F.posexplode(shingles("ws", k)).alias("pos", "h")).join(small.where(F.col("k") == k), "h")
        hit = hit.select("doc_id", "tid", "dn", "item", "n", "k", "total", "pos", "h", "w")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return None
    one = ["doc_id", "tid", "item", "n", "k", "dn", "total"]
    found = found.repartition("doc_id", "tid", "item").distinct()
    found = found.withColumn("prev", F.coalesce(F.lag("pos").over(Window.partitionBy(*one, "h").orderBy("pos")), F.lit(-1)))
    found = found.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("pos", "prev", "w"))).alias("hits"))
    starts = _starts(F.col("hits"), F.col("n"), F.col("k"), F.greatest(F.lit(0), F.col("dn") - F.col("n")), (THRESHOLD - 1e-6) * F.col("total"))
    laid = materialise(found.select("doc_id", "tid", "n", "k", F.explode(starts).alias("start")).distinct(), "laid")
    # only texts with a window are cut into words again, once for each shingle length
    laid = laid.groupBy("doc_id", "tid", "k").agg(F.collect_list(F.struct("start", "n")).alias("wins"))
    laid = laid.select(F.col("doc_id").alias("wid"), F.col("tid").alias("wtid"), "k", "wins")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tid"), F.col(f"`{text_col}`").alias("t"))
    texts = texts.join(_small(laid), (F.col("tid") == F.col("wtid")) & F.col("doc_id").eqNullSafe(F.col("wid")))
    win = texts.select("doc_id", "tid", "k", "wins", hashes_of(F.col("t")).alias("ws")).select("doc_id", "tid", "k", "wins", _shingles_by("ws", "k").alias("all"))
    win = win.select("doc_id", "tid", "k", "all", F.explode("wins").alias("x")).select("doc_id", "tid", "k", "x.start", "x.n", F.slice("all", F.col("x.start") + 1, F.col("x.n") - F.col("k") + 1).alias("sh"))
    win = win.select("doc_id", "tid", "start", "n", "k", "sh", simhash("sh").alias("wp"))
    # the index is asked by the size of the window and a block of its fingerprint, for whatever items lie there
    index = prints.select("item", "n", "k", "own", "total", "fp", F.explode(blocks(F.col("fp"))).alias("blk"))
    near = win.withColumn("blk", F.explode(blocks(F.col("wp")))).join(_small(index), ["n", "k", "blk"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("wp"))) <= RADIUS)
    # a pair that agrees in several blocks is verified once, by the first of them
    agree = F.transform(blocks(F.col("fp").bitwiseXOR(F.col("wp"))), lambda b: b["bits"] == 0)
    near = near.where(F.array_position(agree, True) == F.col("blk.no") + 1).withColumn("sh", F.array_distinct("sh"))
    both = F.filter("own", lambda s: F.array_contains(F.col("sh"), s["h"]))
    common = F.aggregate(both, F.lit(0.0), lambda a, s: a + s["w"])
    near = near.withColumn("similarity", common / (F.col("total") + F.size("sh") - F.size(both)))
    best = near.where(F.col("similarity") >= THRESHOLD - 1e-9).groupBy("doc_id", "tid", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("b"))
    return best.join(named.select("item", "item_id").distinct(), "item").select("doc_id", "tid", "item_id", "b")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start (0-based word), n_words, similarity: the best window of each document and item."""
    found = _found(docs, items, id_col, text_col, item_col, item_text)
    if found is None:
        kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], "doc_id {}, item_id {}, start int, n_words int, similarity double".format(*kinds))
    best = found.groupBy("doc_id", "item_id").agg(F.min("b").alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.round(-F.col("b.s"), 6).alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, whose text has no window of an item."""
    found = _found(docs, items, id_col, text_col, item_col, item_text)
    if found is None:
        return docs
    bad = materialise(found.select(F.col("doc_id").alias("bid"), F.col("tid").alias("btid")).distinct(), "leaks")
    # all columns of a row are held in one struct, so that no name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("tid"))
    return rows.join(_small(bad), (F.col("tid") == F.col("btid")) & F.col("id").eqNullSafe(F.col("bid")), "left_anti").select("row.*")
