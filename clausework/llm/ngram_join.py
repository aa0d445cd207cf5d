"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (equal sets collapse into one class first), columns are 64-bit shingle hashes.
Columns are ordered from rare to heavy; a set of n shingles can only reach the threshold t with another if both have a common
column among their first n - ceil(t n) + 1 columns, so the product runs over that leading block alone. A pair is discarded
when its sizes cannot reach t, or when the overlap accumulated in the leading block plus all that may follow stays below
t / (1 + t) (|a| + |b|); of two sets, the one whose leading block ends first bounds the overlap by its columns that other components
share, before any pair is emitted. Survivors get their exact overlap from the words themselves.

Groups of near copies are not expanded into all pairs: star rounds first compare each set with a few hubs (at first the set nearest to the origin of its group), linked
sets are contracted into components, and only pairs between different components are multiplied out afterwards. No
column, partner or candidate is dropped, so components equal those of the full link graph.

Defined results. Null or empty text, or text of separators only: empty set, linked with nothing, its own component.
Fewer than k words: the whole sequence is the one shingle. Rows that repeat an id: one output row each, by its own text. Ids may be
of any orderable type; a null id is never the smallest, so a component of null ids alone has a null label. Texts of any length are
taken whole. Extra columns, whatever their names, are ignored. An empty table gives an empty result. Ties have no influence:
components are labelled by the smallest id. Texts, shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from clausework.llm import _words as w
from clausework.llm._store import drop, materialise

#: A column is heavy from this share of a partition's sets; at most (average set size / share) columns can be.
HEAVY_SHARE = 0.0005
HEAVY_LEAST = 8
HUBS = 4
#: Frequent columns are counted in runs of sets with so many shingles (8 bytes each), whatever the size of a partition.
SEGMENT_GRAMS = 1 << 20
#: After the first, hub rounds go on while the last product would make more rows than this many times its entries, and each round divides it by PRODUCT_GAIN.
PRODUCT_SHARE = 4
PRODUCT_GAIN = 4
#: Rows of an Arrow batch of texts, and of pairs of texts; a batch of either stays within some MB.
TEXT_ROWS, PAIR_ROWS = 2048, 1024
#: Up to so many (set, document) pairs, 16 bytes each, the texts to verify are picked by a broadcast; beyond, by a shuffled join.
BROADCAST_ROWS = 2_000_000
#: Up to so many groups (some 40 bytes each) the kept rows are picked by a broadcast.
KEPT_ROWS = 500_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text index, sorted distinct shingle hashes) of each text."""
    buf, off = w.utf8(column)
    for a, b, part, at in w.chunks(buf, off):
        start, end, doc = w.spans(part, at)
        h = w.word_hashes(part, start, end, lower=True)
        grams, first = w.windows(h, doc, k)
        words = np.bincount(doc, minlength=b - a)
        ends = np.cumsum(words)
        cut = np.searchsorted(first, np.concatenate([[0], ends]))
        for i in range(b - a):
            if words[i] >= k:
                yield a + i, np.unique(grams[cut[i] : cut[i + 1]])
            elif words[i]:
                yield a + i, w.windows(h[ends[i] - words[i] : ends[i]], np.zeros(words[i], np.int64), int(words[i]))[0]
            else:
                yield a + i, np.zeros(0, np.uint64)


def _signature(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(w.mix(np.array([w.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def _leading(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum with map-side combine, until nothing changes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = materialise(after, "edges")
        n = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        last = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop(edges)
        edges = after
        if n == last:
            break
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return star.unionByName(star.select(F.col("comp").alias("node"), "comp").distinct())


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, n_links, text_id, group_id: den * intersection >= num * union links two documents.

    n_links counts verified links of the document's set to other sets that were needed to connect the components. text_id is a
    hash of the text; group_id, null for empty sets, is a key of the component that does not depend on ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("tid", F.xxhash64("text"))

    def scan(batches):
        seen, some, grams, id_type = set(), [], 0, None

        def counted():
            u, c = np.unique(np.concatenate(some), return_counts=True)
            often = c >= max(HEAVY_LEAST, int(len(some) * HEAVY_SHARE))
            u, c = u[often], c[often]
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), id_type), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["doc_id", "tid", "n", "sig", "times"])

        for batch in batches:
            sizes, sigs, id_type = [], [], batch.schema.field(0).type
            for _, u in _sets(batch.column(2), k):
                sig = _signature(u) if len(u) else 0
                sizes.append(len(u))
                sigs.append(sig)
                if len(u) and sig not in seen:
                    seen.add(sig)
                    some.append(u)
                    grams += len(u)
                    if grams >= SEGMENT_GRAMS:
                        yield counted()
                        some, grams = [], 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(n, pa.int64())], names=["doc_id", "tid", "n", "sig", "times"])
        if some:
            yield counted()

    scanned = materialise(docs.select("doc_id", "tid", "text").mapInArrow(w.released(scan), f"doc_id {kind}, tid long, n long, sig long, times long"), "sets", TEXT_ROWS)
    sets = scanned.where(F.col("times").isNull()).select("doc_id", "tid", "n", "sig")
    ranked = scanned.where(F.col("times").isNotNull()).groupBy("sig").agg(F.sum("times").alias("times"))
    # heavy columns are few by construction (see HEAVY_SHARE), whatever the size of the corpus
    rows = ranked.orderBy(F.desc("times"), "sig").limit(1 << 20).collect()
    heavy = np.array([r["sig"] for r in rows], np.int64).view(np.uint64)
    by = np.argsort(heavy)
    heavy, times = heavy[by], np.array([r["times"] for r in rows], np.int64)[by]
    rank = docs.sparkSession.sparkContext.broadcast((heavy, times))

    def lead(batches):
        heavy, times = rank.value
        seen = set()
        for batch in batches:
            cols, sigs, sizes, known, limits = [], [], [], [], []
            for _, u in _sets(batch.column(0), k):
                if not len(u):
                    continue
                sig = _signature(u)
                if sig in seen:
                    continue
                seen.add(sig)
                n = len(u)
                p = _leading(n, num, den)
                if len(heavy):
                    pos = np.minimum(np.searchsorted(heavy, u), len(heavy) - 1)
                    weight = np.where(heavy[pos] == u, times[pos], 0)
                    if weight.any():
                        by = np.argsort(weight, kind="stable")[:p]
                        u, weight = u[by], weight[by]
                    known.append(weight[:p] > 0)
                    last = int(weight[p - 1])
                else:
                    known.append(np.zeros(p, bool))
                    last = 0
                limits.append(last << 24 | int(u[p - 1]) >> 40)
                cols.append(u[:p])
                sigs.append(sig)
                sizes.append(n)
            if cols:
                lens = [len(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), lens)), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(np.concatenate(known)), pa.array(np.repeat(np.array(limits, np.int64), lens))], names=["col", "sig", "n", "heavy", "lim"])

    entries = docs.select("text").mapInArrow(w.released(lead), "col long, sig long, n int, heavy boolean, lim long")
    # a column that only one set has multiplies to nothing; heavy ones are shared for certain, so their rows are dealt with salt
    entries = entries.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("sig"), F.lit(4096))).otherwise(F.lit(-1))).repartition("col", "salt")
    own = Window.partitionBy("col", "salt")
    light = entries.withColumns({"low": F.min("sig").over(own), "high": F.max("sig").over(own)}).where("heavy or low < high")
    shared = materialise(light.select("col", "sig", "n", "lim").dropDuplicates(["col", "sig"]), "shared", TEXT_ROWS)
    block = materialise(shared.join(shared.groupBy("sig").agg(F.count("*").alias("deg")), "sig"), "block")
    drop(shared)
    # one row stands for each set; a row is told by its id and text, as an id may come with several texts
    reps = sets.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "tid")).alias("r"), F.min("doc_id").alias("least"))
    wanted = materialise(block.select("sig").distinct().join(reps, "sig").select("sig", F.col("r.doc_id").alias("rid"), F.col("r.tid").alias("rt")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(few, (docs["tid"] == F.col("rt")) & docs["doc_id"].eqNullSafe(F.col("rid"))).select("sig", "text")
    texts = materialise(texts, "texts")
    if texts.count() > wanted.count():  # rows that repeat an id and a text
        several, texts = texts, materialise(texts.dropDuplicates(["sig"]), "texts")
        drop(several)
    comp, links, source = None, None, block
    fits = (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)
    last, step, star, old = None, 0, True, None
    while star:
        now = block.withColumn("comp", F.col("sig")) if comp is None else block.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        # columns within one component have nothing left to join; of the others, how many rows would their product have
        mixed = materialise(_mixed(now), "mixed")
        if comp is not None:
            now = materialise(now.join(mixed, "col", "left_semi"), "now")
            drop(source)
            source, block = now, now.drop("comp")
        entries, product = _product(mixed)
        drop(old)
        old = mixed
        star = last is None or product > PRODUCT_SHARE * entries and PRODUCT_GAIN * product < last
        last = product
        if star:
            # first the set with most shared columns, which is nearest to what its group was copied from; then others at random
            first = -F.col("deg") if step == 0 else F.xxhash64("sig", "col", F.lit(step))
            hub = now.groupBy("col").agg(F.min(F.struct(first.alias("p"), "comp", "sig", "n")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            pairs = now.join(hub, "col").where("comp <> h.comp").select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("h.sig").alias("b"), F.col("h.n").alias("nb")).where(fits)
            # each set meets the few hubs that it shares most columns with; whatever else it may link to is left to the last round
            met = pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
            few = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
            pairs = met.withColumn("i", few).where(F.col("i") <= HUBS).select("a", "b")
        else:
            # overlap = columns shared in the leading block of the set whose block ends first, plus at most all its others
            shared = now.groupBy("sig").agg(F.count("*").alias("m")).select("sig", "m")
            now = now.join(shared, "sig").withColumn("most", F.col("m") + F.expr(f"(n * {num} + {den} - 1) div {den} - 1"))
            x, y = (now.select("col", *(F.col(c).alias(c + t) for c in ("sig", "n", "comp", "lim", "most"))) for t in "ab")
            least = F.when(F.col("lima") < F.col("limb"), F.col("mosta")).when(F.col("limb") < F.col("lima"), F.col("mostb")).otherwise(F.greatest("mosta", "mostb"))
            need = (F.col("na") + F.col("nb")) * num
            pairs = x.join(y, "col").where("siga < sigb and compa <> compb").where(fits & (least * (num + den) >= need))
            pairs = pairs.groupBy(F.col("siga").alias("a"), "na", F.col("sigb").alias("b"), "nb").agg(F.count("*").alias("c"))
            room = F.expr(f"(greatest(na, nb) * {num} + {den} - 1) div {den} - 1")
            pairs = pairs.where((F.col("c") + room) * (num + den) >= need).select("a", "b")
        step += 1
        good = materialise(_verified(pairs, texts, k, num, den), "links", PAIR_ROWS)
        links = good if links is None else links.unionByName(good)
        before, comp = comp, materialise(connected(links), "components")
        drop(before)
    drop(old, source, texts, wanted)
    degree = links.select(F.col("a").alias("sig")).unionAll(links.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("n_links"))
    of = reps.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    label = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = of.join(label, "comp").join(degree, "sig", "left").select("sig", "comp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = sets.where("n > 0").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("sig").alias("set_id"), "n_links", F.col("tid").alias("text_id"), F.col("comp").alias("group_id"))
    none = F.lit(None).cast("long")
    return full.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.col("tid").alias("text_id"), none.alias("group_id")))


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which each group of linked ones leaves one row: of the smallest id, then the smallest hash of the text.

    Documents of an empty set are linked with nothing, so all stay. A null id comes after all others. Of rows that repeat an id
    and a text one stays. Group rows are counted before they meet, so a group of any size reaches no task as a whole.
    """
    inner = [F.col(f"`{c}`") for c in docs.columns]
    tid, nothing = F.xxhash64(F.col(f"`{text_col}`")), ~F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = jaccard_components(docs, k, num, den, id_col, text_col).where("group_id is not null")
    each = found.groupBy("group_id", "doc_id", "text_id").agg(F.count("*").alias("times"))
    first = each.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id", "times")).alias("r"))
    kept = materialise(first.select(F.struct(F.col("r.doc_id").alias("d"), F.col("r.text_id").alias("t")).alias("_kept"), F.col("r.times").alias("_times")), "kept")
    # all columns of a row are held in one struct, so that no name can clash
    rows = docs.select(F.struct(*inner).alias("_row"), tid.alias("_tid"), F.col(f"`{id_col}`").alias("_id"), nothing.alias("_none"))
    few = F.broadcast(kept) if kept.count() <= KEPT_ROWS else kept
    one = rows.where("not _none").join(few, (F.col("_tid") == F.col("_kept.t")) & F.col("_id").eqNullSafe(F.col("_kept.d")))
    out = one.where("_times = 1").select("_row").unionByName(rows.where("_none").select("_row"))
    if not kept.where("_times > 1").isEmpty():
        out = out.unionByName(one.where("_times > 1").dropDuplicates(["_id", "_tid"]).select("_row"))
    return out.select("_row.*")


def _mixed(now: DataFrame) -> DataFrame:
    """(col, m, q): columns shared by several components, their entries, and the ordered pairs of entries of different components."""
    each = now.groupBy("col", "comp").agg(F.count("*").alias("m"))
    return each.groupBy("col").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own")).where("m * m > own").select("col", "m", (F.col("m") * F.col("m") - F.col("own")).alias("q"))


def _product(mixed: DataFrame) -> tuple[int, int]:
    """Entries of the mixed columns and the rows that multiplying them out would make at most."""
    r = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("q"), F.lit(0)).alias("q")).first()
    return int(r["m"]), int(r["q"]) // 2


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose exact overlap reaches the threshold; (a, b)."""
    a = texts.select(F.col("sig").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("sig").alias("b"), F.col("text").alias("tb"))

    def overlap(batches):
        for batch in batches:
            keep, at = [], {}
            sets = []
            for name in ("ta", "tb"):  # a hub's text comes again and again; its set is made once
                col = batch.column(batch.schema.get_field_index(name))
                coded = col.dictionary_encode()
                own = [u for _, u in _sets(coded.dictionary, k)]
                sets.append((own, coded.indices.to_pylist()))
            for i in range(batch.num_rows):
                u, v = sets[0][0][sets[0][1][i]], sets[1][0][sets[1][1][i]]
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(w.released(overlap), "a long, b long").distinct()
