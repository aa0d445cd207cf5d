"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document. Every word is removed that a window covers whose word sequence also
starts in a document with a smaller id; windows are judged on the input.

Pass 1: each group of documents makes a count-min sketch over its windows, DEPTH rows of as many cells as suit the size of the
corpus (CELLS_PER_BYTE; a power of two), counting a window once per document. Rows are sent range by range, as the cells touched and
their counts, and the sketches of all groups are merged by adding them cell by cell, one range of one row in a task. A merged cell is
never below the number of documents of any of its windows. Groups get back a bit for each cell that they touched. Pass 2: only windows
whose cells all hold two or more are sent again, with the full 64-bit hash and the group's smallest document, and grouped
exactly. Groups get back the smallest document of each window that documents share, which is all they need. No window is
lost, and nothing is broadcast or collected.

Defined results. Ids are integers of any width; other types raise a TypeError, as their order would be another. Null text: no words; no row is
dropped. Fewer than `width` words: nothing removed. Rows that repeat an id are one document for the comparison, and each comes out
once. A null id is taken as the largest id and never removes anything elsewhere. Texts are taken whole whatever their length. Ties:
of equal windows the smallest id keeps its own. Extra columns, whatever their names, are ignored; an empty table gives an empty result.
Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from clausework.llm import _words as w
from clausework.llm._exchange import MESSAGE, cut, grouped, messages, pack_sorted, shards, unpack_sorted

#: Rows of the sketch, and cells of a row for each byte of text: a window takes some six bytes, so about a third of the cells are touched at most.
DEPTH = 2
CELLS_PER_BYTE = 0.5
_SEEDS = (0x0, 0x8F1BBCDCBFA53E0B, 0x5BE0CD19137E2179, 0x1F83D9ABFB41BD6B)
_LAST = np.int64(np.iinfo(np.int64).max)


def _scan(table: pa.Table, width: int):
    """ids, window hashes, their documents' ids, and per chunk what removal needs."""
    ids = table.column("doc_id").fill_null(int(_LAST)).to_numpy().astype(np.int64)
    buf, off = w.utf8(table.column("text"))
    for a, b, part, at in w.chunks(buf, off):
        start, end, doc = w.spans(part, at)
        h = w.word_hashes(part, start, end, lower=False)
        grams, first = w.windows(h, doc, width)
        yield a, b, part, start, end, doc, grams, first, ids[a:b]


def _distinct(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (window hash, document) of the group, sorted by hash, then document."""
    hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for *_, doc, grams, first, ids in _scan(table, width):
        hs.append(grams)
        ds.append(ids[doc[first]])
    h, d = np.concatenate(hs), np.concatenate(ds)
    by = np.argsort(h, kind="stable")
    h, d = h[by], d[by]
    same = np.flatnonzero(np.concatenate([[False], h[1:] == h[:-1]]))
    if len(same) and not (d[same] >= d[same - 1]).all():
        by = np.lexsort((d, h))
        h, d = h[by], d[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _cells(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Touched cells of a row in order, and which of them each window falls in."""
    if row:
        return np.unique(w.mix(h ^ np.uint64(_SEEDS[row])) >> np.uint64(64 - bits), return_inverse=True)
    cells = h >> np.uint64(64 - bits)  # hashes are sorted already
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    return cells[new], np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words that repeat a passage of an earlier document are cut."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dealt, n = grouped(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, int(size * CELLS_PER_BYTE).bit_length())
    edges = np.array([(i << bits) // n for i in range(n + 1)], np.uint64)

    def sketch(key, table):
        h, rows = _distinct(table, width)[0], []
        for row in range(DEPTH):
            cells, at = _cells(h, row, bits)
            counts = np.minimum(np.bincount(at), 255).astype(np.uint8)
            rows += [(key[0].as_py(), row * n + s, pack_sorted(cells[x]), w.pack(counts[x])) for s, x in cut(cells, edges[1:-1])]
        return messages(rows)

    def merge(key, table):
        s = key[0].as_py()
        low, high = int(edges[s % n]), int(edges[s % n + 1])
        merged = np.zeros(high - low, np.uint8)
        sent = [(unpack_sorted(x) - np.uint64(low)).astype(np.int64) for x in table.column("data").to_pylist()]
        for cells, counts in zip(sent, table.column("more").to_pylist(), strict=True):
            now = merged[cells]
            merged[cells] = np.where(now > 255 - (more := w.unpack(counts, np.uint8)), 255, now + more)
        return messages([(g, s, w.pack(np.packbits(merged[cells] >= 2)), len(cells).to_bytes(8, "little")) for g, cells in zip(table.column("g").to_pylist(), sent, strict=True)])

    def candidates(key, table, answers):
        if not table.num_rows:
            return messages([])
        h, d = _distinct(table, width)
        back = sorted(zip(*(answers.column(x).to_pylist() for x in ("s", "data", "more")), strict=True))
        keep = np.ones(len(h), bool)
        for row in range(DEPTH):
            bits_of = [np.unpackbits(w.unpack(x, np.uint8), count=int.from_bytes(y, "little")) for s, x, y in back if s // n == row]
            keep &= np.concatenate([*bits_of, np.zeros(0, np.uint8)]).astype(bool)[_cells(h, row, bits)[1]]
        h, d = h[keep], d[keep]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        several = np.append(~first[1:], False)[first]  # two or more documents of this group
        h, d = h[first], d[first]
        return messages([(key[0].as_py(), s, pack_sorted(h[at]), _pack_ids(d[at], several[at])) for s, at in shards(h, n)])

    def exact(key, table):
        sent = [(unpack_sorted(x), *_unpack_ids(y)) for x, y in zip(table.column("data").to_pylist(), table.column("more").to_pylist(), strict=True)]
        h, at = np.unique(np.concatenate([x for x, *_ in sent]), return_inverse=True)
        ids, several = np.concatenate([x for _, x, _ in sent]), np.concatenate([x for *_, x in sent])
        least = np.full(len(h), _LAST)
        np.minimum.at(least, at, ids)
        groups = np.bincount(at, minlength=len(h)) + np.bincount(at, weights=several, minlength=len(h))
        out, a = [], 0
        for g, (x, *_) in zip(table.column("g").to_pylist(), sent, strict=True):
            own = at[a : a + len(x)]
            # of use to a group: windows that a smaller document than its own first has, or that several of its documents have
            need = (groups[own] >= 2) & ((least[own] < ids[a : a + len(x)]) | several[a : a + len(x)])
            out.append((g, key[0].as_py(), pack_sorted(x[need]), w.pack(_zig(least[own][need]))))
            a += len(x)
        return messages(out)

    def removed_of(key, table, answers):
        parts = [unpack_sorted(x) for x in answers.column("data").to_pylist()]
        least = [_zag(w.unpack(x, np.uint64)) for x in answers.column("more").to_pylist()]
        known, least = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([*least, np.zeros(0, np.int64)])
        by = np.argsort(known)
        known, least = known[by], least[by]
        words, removed, kept = [], [], []
        for a, b, part, start, end, doc, grams, first, ids in _scan(table, width) if table.num_rows else ():
            covered = np.zeros(len(start) + 1, np.int64)
            if len(known) and len(grams):
                pos = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hit = first[(known[pos] == grams) & (least[pos] < ids[doc[first]])]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + width, -1)
            gone = np.cumsum(covered[:-1]) > 0
            total = np.bincount(doc, minlength=b - a)
            lost = np.bincount(doc[gone], minlength=b - a)
            words.append(total)
            removed.append(lost)
            ends = np.cumsum(total)
            raw = part.tobytes()
            for i in range(b - a):
                at = range(ends[i] - total[i], ends[i]) if not lost[i] else np.flatnonzero(~gone[ends[i] - total[i] : ends[i]]) + (ends[i] - total[i])
                kept.append(b" ".join([raw[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)]) if len(at) else b"")
        none = [np.zeros(0, np.int64)]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.concatenate(words or none), pa.int64()), "n_removed": pa.array(np.concatenate(removed or none), pa.int64()), "kept_text": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())})

    sent = dealt.groupBy("g").applyInArrow(sketch, MESSAGE)
    often = sent.groupBy("s").applyInArrow(merge, MESSAGE)
    again = dealt.groupBy("g").cogroup(often.groupBy("g")).applyInArrow(candidates, MESSAGE)
    shared = again.groupBy("s").applyInArrow(exact, MESSAGE)
    return dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(removed_of, "doc_id long, n_words long, n_removed long, kept_text string")


def _zig(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small magnitudes to small numbers."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _zag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _pack_ids(ids: np.ndarray, marked: np.ndarray) -> bytes:
    one = w.pack(_zig(ids))
    return len(one).to_bytes(8, "little") + one + w.pack(np.packbits(marked))


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    ids = _zag(w.unpack(data[8 : 8 + n], np.uint64))
    return ids, np.unpackbits(w.unpack(data[8 + n :], np.uint8), count=len(ids)).astype(bool)
