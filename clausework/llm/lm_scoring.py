"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The context of a token is r = R[a] C1 + R[b] C2, with a and b what stands one and two tokens before. The target is reached in two
steps, both log-bilinear in r and both normalised exactly. First the class: the `classes` commonest training tokens are classes of
their own, class 0 holds all others. Then, within class 0, the unit: every training token that occurs sqrt(N) / UNIT_SHARE times or more
has a unit with a vector of its own, so the modelled vocabulary grows with the corpus; the rest are hashed into units, whose number
grows as well, and are told apart there by add-one unigram counts. So the score is a normalised probability over the training vocabulary
and one unknown token in each hashed unit. As contexts, tokens of class 0 are hashed into CONTEXTS vectors.

Training is numpy NCE in every input partition over all of its training tokens from one common start; parameters are averaged by
tokens in a tree, once per round. Because r is a sum, the normalisers of all context pairs are matrix products: exp(Q C1 R) by
exp(Q C2 R) for the classes, and the same, block by block, for the units. Scoring a token takes table look-ups and two short products.

Counts cover every training document. Each group of documents sends packed distinct token hashes with counts to hash shards and
gets the corpus counts back in the same order. What is collected and broadcast grows as the square root of the corpus.

Defined results. Ids may be of any type. Null or word-less text: the end token alone. With no training documents all counts are 0, N = V = 0.
Rows that repeat an id are scored and counted row by row. A null id counts as the empty text in the fold. Texts are taken whole whatever
their length. Extra columns, whatever their names, are ignored; an empty table gives an empty result. Ties among the commonest tokens
go to the smaller hash. Tokens are 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import _words as w
from clausework.llm._exchange import MESSAGE, grouped, messages, pack_sorted, shards, unpack_sorted
from clausework.llm._store import materialise

END = np.uint64(0x0123456789ABCDEF)
CLASSES = 511
UNIT_SHARE = 16
#: Bits of a token's hash that choose the context vector of a token of class 0.
CONTEXT_BITS = 8
WIDTH = 24
ROUNDS = 2
BATCH = 4096
NOISE = 32
RATE = 0.1


def _tokens(column: pa.Array):
    """Per run of texts: first, after last, token hashes with an end token after each text, their texts."""
    buf, off = w.utf8(column)
    for a, b, part, at in w.chunks(buf, off):
        start, end, doc = w.spans(part, at)
        h = w.word_hashes(part, start, end, lower=True)
        ends = np.cumsum(np.bincount(doc, minlength=b - a))
        yield a, b, np.insert(h, ends, END), np.insert(doc, ends, np.arange(b - a))


def _group_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the group, whether each is for training, and its row."""
    out = table.column("out").to_numpy().astype(bool)
    hs, ts, ds = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for a, b, h, doc in _tokens(table.column("text")):
        hs.append(h)
        ds.append(doc + a)
        ts.append(~out[a:b][doc])
    return np.concatenate(hs), np.concatenate(ts), np.concatenate(ds)


def _place(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash would stand, and whether it does."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


class Vocabulary:
    """Tokens of classes and units of their own (sorted hashes, counts), and the hashed units (tokens, distinct tokens)."""

    def __init__(self, top: np.ndarray, top_n: np.ndarray, own: np.ndarray, own_n: np.ndarray, bin_n: np.ndarray, bin_v: np.ndarray):
        self.top, self.top_n, self.own, self.own_n, self.bin_n, self.bin_v = top, top_n, own, own_n, bin_n, bin_v
        self.shift = np.uint64(64 - (len(bin_n).bit_length() - 1))
        self.bos = len(top) + 1
        self.contexts = self.bos + 1 + (1 << CONTEXT_BITS)
        rare = np.concatenate([own_n, bin_n]).astype(np.float64)
        self.noise = _share(np.concatenate([[rare.sum()], top_n]))
        self.noise2 = _share(rare)

    def classes(self, h: np.ndarray) -> np.ndarray:
        at, hit = _place(self.top, h)
        return np.where(hit, at + 1, 0)

    def units(self, h: np.ndarray) -> np.ndarray:
        """Of tokens of class 0."""
        at, hit = _place(self.own, h)
        return np.where(hit, at, len(self.own) + (h >> self.shift).astype(np.int64))

    def before(self, c: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors one and two tokens before, in the same text."""
        own = np.where(c > 0, c, self.bos + 1 + (h >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)).astype(np.uint16)
        out = []
        for back in (1, 2):
            x = np.full(len(c), self.bos, np.uint16)
            if len(c) > back:
                x[back:] = np.where(doc[back:] == doc[:-back], own[:-back], self.bos)
            out.append(x)
        return out[0], out[1]


def _share(n: np.ndarray) -> np.ndarray:
    p = n.astype(np.float64) + 1
    return (p / p.sum()).astype(np.float32)


class Model:
    def __init__(self, words: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = words
        wide = lambda n: rng.normal(0, 0.1, (n, WIDTH))
        start = [wide(words.contexts), np.eye(WIDTH) * 0.5, np.eye(WIDTH) * 0.5, wide(len(words.noise)), np.log(words.noise), wide(len(words.noise2)), np.log(words.noise2)]
        self.p = [x.astype(np.float32) for x in start]

    def tables(self) -> tuple[np.ndarray, ...]:
        """Class scores by context, bias, log normalisers of all context pairs; context vectors and normalisers for the units."""
        r, c1, c2, q, bias, q2, bias2 = self.p
        a, b = (r @ c1).astype(np.float64), (r @ c2).astype(np.float64)
        one, two = a @ q.T, b @ q.T
        return one, two, bias.astype(np.float64), _normaliser(a, b, q, bias), a.astype(np.float32), b.astype(np.float32), _normaliser(a, b, q2, bias2)

    def fit(self, h: np.ndarray, doc: np.ndarray, rng: np.random.Generator, state: list[np.ndarray]) -> None:
        """One pass of minibatch NCE with shared noise and Adagrad."""
        words, (r, c1, c2, q, bias, q2, bias2) = self.words, self.p
        c = words.classes(h)
        a, b = words.before(c, h, doc)
        unit = np.full(len(h), -1, np.int64)
        rare = c == 0
        unit[rare] = words.units(h[rare])
        c = c.astype(np.uint16)
        draw, draw2 = np.cumsum(words.noise, dtype=np.float64), np.cumsum(words.noise2, dtype=np.float64)
        order = rng.permutation(len(h))
        for i in range(0, len(h), BATCH):
            at = order[i : i + BATCH]
            wa, wb, wt, wu = a[at], b[at], c[at], unit[at]
            ctx = (r @ c1)[wa] + (r @ c2)[wb]  # one product a context, not a token
            dctx, gq, gb = _contrast(ctx, wt, q, bias, words.noise, draw, rng)
            some = np.flatnonzero(wu >= 0)
            if len(some):
                more, sparse, g2, gb2 = _contrast(ctx[some], wu[some], q2, bias2, words.noise2, draw2, rng, sparse=True)
                dctx[some] += more
                for p, g, s in ((q2, g2, state[5]), (bias2, gb2, state[6])):
                    g = g / np.float32(len(at))
                    s[sparse] += g * g
                    p[sparse] -= RATE * g / np.sqrt(s[sparse])
            da, db = _scatter(wa, dctx, len(r)), _scatter(wb, dctx, len(r))
            for p, g, s in zip(self.p, (da @ c1.T + db @ c2.T, r.T @ da, r.T @ db, gq, gb), state, strict=False):
                g = g / np.float32(len(at))
                s += g * g
                p -= RATE * g / np.sqrt(s)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[at : at + x.size].reshape(x.shape).astype(np.float32).copy()
            at += x.size


def _normaliser(a: np.ndarray, b: np.ndarray, q: np.ndarray, bias: np.ndarray, block: int = 4096) -> np.ndarray:
    """log sum over targets of exp(a q + b q + bias) for all pairs of contexts, target block by target block."""
    top1, top2, total = np.full((len(a), 1), -np.inf), np.full((len(b), 1), -np.inf), 0.0
    for i in range(0, len(q), block):
        part = q[i : i + block].T.astype(np.float64)
        top1, top2 = np.maximum(top1, (a @ part).max(1, keepdims=True)), np.maximum(top2, (b @ part).max(1, keepdims=True))
    for i in range(0, len(q), block):
        part = q[i : i + block].T.astype(np.float64)
        total = total + (np.exp(a @ part - top1) * np.exp(bias[i : i + block].astype(np.float64))) @ np.exp(b @ part - top2).T
    return np.log(total) + top1 + top2.T


def _contrast(ctx: np.ndarray, target: np.ndarray, q: np.ndarray, bias: np.ndarray, noise: np.ndarray, draw: np.ndarray, rng: np.random.Generator, sparse: bool = False):
    """Gradients of the NCE loss: of the contexts, then of the targets (sparse: the touched ones, their vectors, their biases)."""
    fake = np.minimum(np.searchsorted(draw, rng.random(NOISE) * draw[-1], side="right"), len(noise) - 1)
    mine = q[target]
    pos = np.einsum("ij,ij->i", ctx, mine) + bias[target] - np.log(NOISE * noise[target])
    dp = -1 / (1 + np.exp(np.clip(pos, -30, 30)))
    dn = ctx @ -q[fake].T  # 1 / (1 + exp(-score)), in place
    dn -= bias[fake] - np.log(NOISE * noise[fake])
    np.exp(np.clip(dn, -30, 30, out=dn), out=dn)
    dn += 1
    np.reciprocal(dn, out=dn)
    dctx = mine * dp[:, None]
    dctx += dn @ q[fake]
    if not sparse:
        gq, gb = _scatter(target, dp[:, None] * ctx, len(q)), np.bincount(target, weights=dp, minlength=len(q)).astype(np.float32)
        np.add.at(gq, fake, dn.T @ ctx)
        np.add.at(gb, fake, dn.sum(0))
        return dctx, gq, gb
    touched, at = np.unique(np.concatenate([target, fake]), return_inverse=True)
    gq = _scatter(at, np.concatenate([dp[:, None] * ctx, dn.T @ ctx]), len(touched))
    gb = np.bincount(at, weights=np.concatenate([dp, dn.sum(0)]), minlength=len(touched)).astype(np.float32)
    return dctx, touched, gq, gb


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    at = at.astype(np.uint16) if n <= 1 << 16 else at  # sorted by radix
    by = np.argsort(at, kind="stable")
    s = at[by]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[s[new]] = np.add.reduceat(rows[by], new, axis=0)
    return out


def _mean(rows: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    n, total = sum(x for x, _ in rows), None
    for x, v in rows:
        total = v * np.float64(x / n) if total is None else total + v * np.float64(x / n)
    return n, total.astype(np.float32)


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """NCE in every partition over all its training tokens (text, out), averaged in a tree."""
    for step in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((model.words, model.flat()))

        def run(batches, shared=shared, step=step):
            words, flat = shared.value
            own = Model(words)
            own.load(flat)
            rng, state, seen = np.random.default_rng(step), [np.full(x.shape, 1e-3, np.float32) for x in own.p], 0
            for batch in batches:
                use = pa.array(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                for _, _, h, doc in _tokens(batch.column(0).filter(use)):
                    own.fit(h, doc, rng, state)
                    seen += len(h)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.flat().tobytes()], pa.binary())], names=["n", "p"])

        def average(table):
            rows = ((n.as_py(), np.frombuffer(p.as_py(), np.float32)) for n, p in zip(table.column("n"), table.column("p"), strict=True))
            n, p = _mean(list(rows))
            return pa.table({"n": pa.array([n], pa.int64()), "p": pa.array([p.tobytes()], pa.binary())})

        parts = docs.select("text", "out").mapInArrow(w.released(run), "n long, p binary").withColumn("k", F.spark_partition_id())
        for width in (1024, 32):  # a tree, so that no task and no driver holds the parameters of many partitions
            parts = parts.withColumn("k", F.pmod("k", F.lit(width)).cast("int")).groupBy("k").applyInArrow(average, "n long, p binary").withColumn("k", F.spark_partition_id())
        rows = [(r["n"], np.frombuffer(bytes(r["p"]), np.float32)) for r in parts.select("n", "p").toLocalIterator()]  # 32 at most, one at a time
        shared.unpersist()
        if rows:
            model.load(_mean(rows)[1])
    return model


def _vocabulary(lists: DataFrame, total_n: int, classes: int) -> Vocabulary:
    """Of the shards' packed tokens (data) and counts (more)."""
    least = max(2, int(math.sqrt(total_n) / UNIT_SHARE))
    bits = max(8, int(math.sqrt(total_n) / 4).bit_length())

    def pick(batches):
        for batch in batches:
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, c = unpack_sorted(d), w.unpack(m, np.uint64).astype(np.int64)
                own = c >= least
                rest, place = c[~own], (u[~own] >> np.uint64(64 - bits)).astype(np.int64)
                bins, at = np.unique(place, return_inverse=True)
                n, v = np.bincount(at, weights=rest).astype(np.int64), np.bincount(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [own.sum(), len(bins)]).astype(np.int8)), pa.array(np.concatenate([u[own].view(np.int64), bins])), pa.array(np.concatenate([c[own], n])), pa.array(np.concatenate([np.zeros(own.sum(), np.int64), v]))], names=["kind", "h", "c", "v"])

    rows = materialise(lists.select("data", "more").mapInArrow(pick, "kind byte, h long, c long, v long"), "vocabulary")
    got = rows.groupBy("kind", "h").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toArrow()
    kind, h, c, v = (got.column(x).to_numpy() for x in ("kind", "h", "c", "v"))
    words, n = h[kind == 0].view(np.uint64), c[kind == 0]
    by = np.lexsort((words, -n))
    top, own = np.sort(by[:classes]), np.sort(by[classes:])
    top, own = top[np.argsort(words[top])], own[np.argsort(words[own])]
    bin_n, bin_v = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    bin_n[h[kind == 1]], bin_v[h[kind == 1]] = c[kind == 1], v[kind == 1]
    return Vocabulary(words[top], n[top], words[own], n[own], bin_n, bin_v)


def score(docs: DataFrame, folds: int = 7, held: int = 2, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    dealt, n = grouped(docs, id_col, text_col, out=fold)

    def send(key, table):
        h, train, _ = _group_tokens(table)
        u, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, weights=train, minlength=len(u)).astype(np.uint32)
        return messages([(key[0].as_py(), s, pack_sorted(u[x]), w.pack(c[x])) for s, x in shards(u, n)])

    def total(key, table):
        sent = [(unpack_sorted(x), w.unpack(y, np.uint32)) for x, y in zip(table.column("data").to_pylist(), table.column("more").to_pylist(), strict=True)]
        u, at = np.unique(np.concatenate([x for x, _ in sent]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([y for _, y in sent])).astype(np.uint64)
        out, a = [], 0
        for g, (x, _) in zip(table.column("g").to_pylist(), sent, strict=True):
            out.append((g, key[0].as_py(), w.pack(c[at[a : a + len(x)]]), None))
            a += len(x)
        known = c > 0
        out.append((-1, key[0].as_py(), np.array([c.sum(), known.sum()], np.uint64).tobytes(), None))
        out.append((-2, key[0].as_py(), pack_sorted(u[known]), w.pack(c[known])))
        return messages(out)

    answers = materialise(dealt.groupBy("g").applyInArrow(send, MESSAGE).groupBy("s").applyInArrow(total, MESSAGE), "counts")
    sums = [np.frombuffer(bytes(r["data"]), np.uint64) for r in answers.where("g = -1").select("data").collect()]  # one short row a shard
    total_n, total_v = (int(sum(x[i] for x in sums)) for i in (0, 1))
    words = _vocabulary(answers.where("g = -2"), total_n, classes)
    model = train(docs.select(F.col(f"`{text_col}`").alias("text"), fold.alias("out")), Model(words))
    shared = docs.sparkSession.sparkContext.broadcast((words, model.p[5], model.p[6], model.tables()))

    def judge(key, table, back):
        if not table.num_rows:
            return pa.table({x: pa.array([], t) for x, t in (("doc_id", table.schema.field("doc_id").type), *kinds)})
        words, q2, bias2, (one, two, bias, z, va, vb, z2) = shared.value
        h, _, doc = _group_tokens(table)
        u, at = np.unique(h, return_inverse=True)
        parts = sorted(zip(back.column("s").to_pylist(), back.column("data").to_pylist(), strict=True))
        c = np.concatenate([w.unpack(x, np.uint64) for _, x in parts]).astype(np.float64)[at]
        rows = table.num_rows
        cls = words.classes(h)
        a, b = words.before(cls, h, doc)
        lp = one[a, cls] + two[b, cls] + bias[cls] - z[a, b]
        rare = np.flatnonzero(cls == 0)
        for i in range(0, len(rare), 1 << 16):
            x = rare[i : i + (1 << 16)]
            unit = words.units(h[x])
            lp[x] += np.einsum("ij,ij->i", va[a[x]] + vb[b[x]], q2[unit]) + bias2[unit] - z2[a[x], b[x]]
            hashed = unit >= len(words.own)
            place = np.maximum(unit - len(words.own), 0)
            lp[x] += np.where(hashed, np.log((c[x] + 1) / (words.bin_n[place] + words.bin_v[place] + 1)), 0)
        base = np.log10((c + 1) / (total_n + total_v + 1))
        add = lambda x: np.bincount(doc, weights=x, minlength=rows)
        whole = lambda x: pa.array(np.rint(x).astype(np.int64))
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("out"), "n_tokens": whole(add(np.ones(len(h)))), "n_known": whole(add(c > 0)), "train_tokens": pa.array(np.full(rows, total_n, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(lp) / np.log(10))})

    kinds = (("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
    back = answers.where("g >= 0").select("g", "s", "data")
    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
