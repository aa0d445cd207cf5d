"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences; p(sentence) is logistic in its hashed words, p(document) = 1 - prod(1 - p(sentence)). The
gradient of the document's log-likelihood flows to its sentences, so the sentences that make a document toxic are found
without sentence labels. Training is numpy on the driver over a sample of at most TRAIN_DOCS labelled rows of at most TRAIN_BYTES
bytes (the documented bound; rows in order of a hash of the id); scoring is Arrow batches over every whole text, with the
weight table of 2^FEATURE_BITS floats broadcast.

Defined results. Null, empty or word-less texts get the score of one empty sentence, the bias alone. Rows that repeat an id, or have
none, are scored row by row; a null id counts as the empty text in the fold. Of several labels of an id the largest counts. Documents without
a label, and labels without a document, do not train; with no labelled rows at all, or one class only, the bias is the smoothed share of
label 1. Of sentences with equal scores the first is the most offending. Texts are scored whole whatever their length. Extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import _words as w
from clausework.llm._store import materialise

FEATURE_BITS = 18
TRAIN_DOCS = 12_000
TRAIN_BYTES = 40_000_000
EPOCHS = 30
SLICE = 256
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_JUNK = np.frombuffer(bytes(x if _WORD[x] else 32 for x in range(256)), np.uint8)


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Per distinct (sentence, feature): sentence and feature; per sentence: document; number of documents; spans."""
    buf, off = w.utf8(column)
    codes, docs, base, where = [], [], 0, []
    for a, b, part, at in w.chunks(buf, off):
        start, end, doc = w.spans(_JUNK[part], at)
        h = w.word_hashes(part, start, end, lower=True)
        stops = np.concatenate([[0], np.cumsum(_STOP[part])])
        key = stops[start] + (doc << 32)  # a sentence ends with a stop or its document
        new = np.ones(len(start), bool)
        new[1:] = key[1:] != key[:-1]
        sent = np.cumsum(new) - 1
        owner = doc[new] + a
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(start))[: len(firsts)] - 1
        where.append(np.stack([owner, start[firsts] - at[doc[new]], end[lasts] - at[doc[new]]], 1))
        feat = (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        codes.append(np.unique((sent + base) << FEATURE_BITS | feat))  # sentences lie within a chunk
        docs.append(owner)
        base += len(owner)
    code = np.concatenate([*codes, np.zeros(0, np.int64)])
    owner, spans = np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*where, np.zeros((0, 3), np.int64)])
    return code >> FEATURE_BITS, code & ((1 << FEATURE_BITS) - 1), owner, len(off) - 1, spans


def _forward(weights: np.ndarray, bias: float, sent: np.ndarray, feat: np.ndarray, owner: np.ndarray, n: int):
    z = np.bincount(sent, weights=weights[feat], minlength=len(owner)) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    quiet = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    empty = np.bincount(owner, minlength=n) == 0
    quiet[empty] = np.log1p(-1 / (1 + np.exp(-bias)))
    return p, -np.expm1(quiet)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Feature weights and bias that fit the document labels through the noisy-or."""
    weights = np.zeros(1 << FEATURE_BITS)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return weights.astype(np.float32), float(np.log(share / (1 - share)))
    # two passes over slices of the sample: what each feature occurs with, then the features that train; the rest is never held
    size, n = 1 << FEATURE_BITS, len(texts)
    cut = lambda i: bags(pa.array(texts[i : i + SLICE], pa.large_string()))
    df, pos = np.zeros(size), np.zeros(size)
    for i in range(0, n, SLICE):
        sent, feat, owner, _, _ = cut(i)
        pair = np.unique((owner[sent] << FEATURE_BITS) | feat)
        df += np.bincount(pair & (size - 1), minlength=size)
        pos += np.bincount(pair & (size - 1), weights=labels[i + (pair >> FEATURE_BITS)], minlength=size)
    # a feature trains if its documents' labels differ clearly from the corpus; the rest stays 0
    z = (pos - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    use = (df >= 4) & (z > 3.0) & (pos >= 3)
    sents, feats, owners, base = [], [], [], 0
    for i in range(0, n, SLICE):
        sent, feat, owner, _, _ = cut(i)
        keep = use[feat]
        sents.append((sent[keep] + base).astype(np.int32))
        feats.append(feat[keep].astype(np.int32))
        owners.append((owner + i).astype(np.int32))
        base += len(owner)
    sent, feat, owner = np.concatenate(sents), np.concatenate(feats), np.concatenate(owners)
    bias, grad2, bias2 = -6.0, np.full(1 << FEATURE_BITS, 1e-6), 1e-6
    weights[use] = np.log((pos[use] + 0.5) / (df[use] - pos[use] + 0.5)) - np.log(share / (1 - share))
    for _ in range(EPOCHS):
        p, q = _forward(weights, bias, sent, feat, owner, n)
        q = np.clip(q, 1e-9, 1 - 1e-9)
        back = np.where(labels == 1, -(1 - q) / q, 1.0)[owner] * p  # d loss / d z of each sentence
        g = np.bincount(feat, weights=back[sent], minlength=size) + 1e-2 * weights * use
        gb = back.sum()
        grad2 += g * g
        bias2 += gb * gb
        weights -= 0.5 * g / np.sqrt(grad2)
        bias -= 0.3 * gb / np.sqrt(bias2)
    return weights.astype(np.float32), float(bias)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """The bounded training sample."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).join(F.broadcast(lab), "_id")
    # written in one distributed job, so that the driver reads only the sample, in order of the hash
    rows = materialise(rows.select("t", "y", F.xxhash64("_id").alias("o")), "sample").orderBy("o", "t").select("t", "y").toLocalIterator(prefetchPartitions=False)
    texts, ys, left = [], [], TRAIN_BYTES
    for r in rows:
        size = len(r["t"].encode())
        if size > left or len(texts) >= TRAIN_DOCS:
            continue  # a text beyond the bound leaves room for the shorter ones after it
        left -= size
        texts.append(r["t"])
        ys.append(r["y"])
    return texts, np.array(ys, np.int64)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, worst_start, worst_end, worst_score: the probability, and the most offending sentence in UTF-8 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            column = batch.column(1)
            for i in range(0, batch.num_rows, 512):
                ids, part = batch.column(0).slice(i, 512), column.slice(i, 512)
                sent, feat, owner, n, where = bags(part)
                p, q = _forward(weights, bias, sent, feat, owner, n)
                first, last, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                if len(p):
                    by = np.lexsort((-np.arange(len(p)), p, owner))
                    end = np.append(owner[by][1:] != owner[by][:-1], True)
                    best = by[end]
                    spans = where[best]
                    first[owner[best]], last[owner[best]], top[owner[best]] = spans[:, 1], spans[:, 2], p[best]
                yield pa.RecordBatch.from_arrays([ids, pa.array(q), pa.array(first), pa.array(last), pa.array(top)], names=["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(w.released(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, worst_start long, worst_end long, worst_score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """score() of all documents, learning only from rows whose crc32(id) mod folds is not held; with held_out and predicted."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    model = train(*sample(docs.where(fold != held), labels, id_col, text_col, label_col))
    out = score(docs, model, id_col, text_col)
    mine = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    return out.withColumns({"held_out": mine == held, "predicted": (F.col("score") >= 0.5).cast("int")})
