"""SentencePiece encoding and decoding by a shared-prefix forward pass over distinct marked words.

The text gets the model's space mark before each word; since no piece holds a mark after another character, marked words are
independent. The distinct words of a slice are sorted and walked like a trie, depth first: a stack holds the forward state of each
prefix, and a word only computes what it does not share with the word before it. The pieces that end at a place are the
outputs of an automaton over the vocabulary, so a place costs one transition. The public model is a BPE model, for which a
Viterbi pass over all piece scores gives other segmentations than the library's merges; so an edge of the lattice is only open where
merging the characters of two neighbouring pieces leaves the two. A segmentation is the library's exactly when all its neighbours
are so; hence one open path leads to each prefix, whose forward score (the sum of piece scores) is the best, and the backtrace
gives the library's ids. Characters outside the vocabulary become byte pieces, with no score.

Defined results. Null text stays null: no tokens, null ids, decoded null, digest of nothing, round trip true. Empty text: no tokens.
Rows that repeat an id are encoded row by row. There are no ties: one segmentation is the right one. Texts are encoded whole whatever
their length; memory is bounded by an Arrow batch, the longest text, SLICE, WORDS, PAIRS and STEPS. Extra columns are ignored by
encode(); digest() keeps those it is told to, of any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import _words as w

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words (about 30 bytes each), neighbouring pieces and transitions (about 150 bytes) that a worker remembers; what is forgotten is worked out again.
WORDS, PAIRS, STEPS = 1_000_000, 150_000, 150_000
#: Bytes of text that are encoded at a time; a longer text is a slice of its own.
SLICE = 2 << 20


class _Memory:
    """Ids of words by hash, in sorted arrays; beyond WORDS the half that was asked for longest ago goes."""

    def __init__(self):
        self.h, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.used, self.clock, self.pool = np.zeros(0, np.int32), 0, np.zeros(0, np.uint16)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which are known, the ids of those, and the number of ids of each (0 for the others)."""
        n = np.zeros(len(h), np.int64)
        if not len(self.h) or not len(h):
            return np.zeros(len(h), bool), np.zeros(0, np.uint16), n
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        at = at[hit]
        self.clock += 1
        self.used[at] = self.clock
        n[hit] = self.n[at]
        return hit, self.pool[_runs(self.at[at], n[hit])], n

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        start = np.cumsum(n) - n
        new, first = np.unique(h, return_index=True)
        ok = n[first] < 64  # longer words are not remembered
        new, first = new[ok], first[ok]
        if len(self.h):
            ok = self.h[np.minimum(np.searchsorted(self.h, new), len(self.h) - 1)] != new
            new, first = new[ok], first[ok]
        if len(self.h) + len(new) > WORDS:
            stay = self.used >= np.partition(self.used, len(self.h) // 2)[len(self.h) // 2] if len(self.h) else np.zeros(0, bool)
            if stay.mean() > 0.75 if len(stay) else True:
                stay[:] = False
            size = self.n[stay].astype(np.int64)
            self.pool = self.pool[_runs(self.at[stay], size)]
            self.h, self.n, self.used, self.at = self.h[stay], self.n[stay], self.used[stay], np.cumsum(size) - size
        size = n[first].astype(np.int64)
        to = np.searchsorted(self.h, new)
        self.h, self.n = np.insert(self.h, to, new), np.insert(self.n, to, size.astype(np.uint16))
        self.at = np.insert(self.at, to, len(self.pool) + np.cumsum(size) - size)
        self.used = np.insert(self.used, to, self.clock)
        self.pool = np.concatenate([self.pool, ids[_runs(start[first], size)]])


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.rank = {p: -self.score[i] for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if byte[i]}
        raw = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of each piece that merges into itself
        for p, i in self.ids.items():
            parts, cut = self.merged(p), 0
            if parts == [p] and len(p) > 1:
                cut = self._last_merge(p)
                self.halves[i] = self.ids[p[:cut]], self.ids[p[cut:]]
        self._automaton([p for p, i in self.ids.items() if len(p) == 1 or i in self.halves])
        self.memory = _Memory()
        self.stable: dict[int, bool] = {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Merges by best piece score, leftmost first, down to `least` parts: the definition, for short strings."""
        parts, rank = list(text), self.rank
        while len(parts) > least:
            best = min(((rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1)))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _last_merge(self, piece: str) -> int:
        return len(self.merged(piece, 2)[0])

    def _automaton(self, pieces: list[str]) -> None:
        """All pieces that end at a place, longest first, are the outputs of one state (Aho and Corasick)."""
        child: dict[tuple[int, str], int] = {}
        depth, own = [0], [-1]
        for p in pieces:
            at = 0
            for x in p:
                to = child.get((at, x))
                if to is None:
                    to = child[at, x] = len(depth)
                    depth.append(depth[at] + 1)
                    own.append(-1)
                at = to
            own[at] = self.ids[p]
        self.fail, self.ends = [0] * len(depth), [()] * len(depth)
        self.child = {at << 21 | ord(x): to for (at, x), to in child.items()}
        for (at, x), to in sorted(child.items(), key=lambda e: depth[e[1]]):
            back = self.fail[at]
            while back and (back, x) not in child:
                back = self.fail[back]
            self.fail[to] = child.get((back, x), 0) if at else 0
            mine = ((depth[to], own[to]),) if own[to] >= 0 else ()
            self.ends[to] = mine + self.ends[self.fail[to]]
        self.steps: dict[int, int] = {}

    def _step(self, state: int, x: int) -> int:
        at, child = state, self.child
        while at and at << 21 | x not in child:
            at = self.fail[at]
        if len(self.steps) >= STEPS:
            self.steps.clear()
        to = self.steps[state << 21 | x] = child.get(at << 21 | x, 0)
        return to

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces leaves the two: the merges along their border are undone, last first;
        one across the border that came before the merge undone last would have been made."""
        pieces, rank, halves, limit = self.pieces, self.rank, self.halves, np.inf
        while True:
            across = rank.get(pieces[a] + pieces[b])
            if across is not None and across < limit:
                return False
            ra, rb = rank[pieces[a]] if a in halves else -1, rank[pieces[b]] if b in halves else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 0.5, halves[b][0]  # of equal merges the left one comes first

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct words."""
        ends, steps, stable, score = self.ends, self.steps, self.stable, self.score
        out, before = [], ""
        # by prefix: the automaton's state, the last piece (-1: a character of no piece), where it starts, the forward score
        stack = [(0, -1, 0, 0.0)]
        for word in words:
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del stack[n + 1 :]
            at, end = stack[n][0], n
            for c in word[n:]:
                end += 1
                x = at << 21 | ord(c)
                at = steps[x] if x in steps else self._step(at, ord(c))
                piece, start = -1, end - 1
                for size, i in ends[at]:
                    if size == end:
                        piece, start = i, 0
                        break
                    if size > end:
                        continue
                    a = stack[end - size][1]
                    if size == 1 or a < 0:
                        piece, start = i, end - size
                        break
                    key = a << 15 | i
                    good = stable.get(key)
                    if good is None:
                        if len(stable) >= PAIRS:
                            stable.clear()
                        good = stable[key] = self.fits(a, i)
                    if good:
                        piece, start = i, end - size
                        break
                stack.append((at, piece, start, stack[start][3] + score[piece] if piece >= 0 else stack[start][3]))
            back = []
            while end:
                _, piece, start, _ = stack[end]
                if piece >= 0:
                    back.append(piece)
                else:
                    back += [self.byte_id[x] for x in reversed(word[end - 1].encode())]
                end = start
            back.reverse()
            out.append(back)
            before = word
        return out

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of each) of distinct words without marks; those remembered are not walked again."""
        buf, off = w.utf8(words)
        h = w.word_hashes(buf, off[:-1], off[1:], lower=False)
        hit, ids, n = self.memory.look(h)
        # a word is told by its hash, and by what its ids decode to
        back, to = self.decode_flat(ids, np.concatenate([[0], np.cumsum(n)]))
        size, long = np.diff(off), np.diff(to)
        same = hit & (long == size + 1)
        at, begin = _runs(off[:-1][same], size[same]), _runs(to[:-1][same] + 1, size[same])
        wrong = np.bincount(np.repeat(np.flatnonzero(same), size[same]), weights=buf[at] != back[begin], minlength=len(h)) > 0
        hit = same & ~wrong
        miss = np.flatnonzero(~hit)
        texts = [MARK + x for x in words.take(pa.array(miss)).to_pylist()]
        by = sorted(range(len(texts)), key=texts.__getitem__)
        got = self.encode_words([texts[i] for i in by])
        new = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter((i for x in got for i in x), np.uint16, int(new.sum()))
        order = miss[by] if len(by) else miss
        length = np.zeros(len(h), np.int64)
        length[hit], length[order] = n[hit], new
        pool = np.concatenate([ids, flat])
        start = np.cumsum(n) - n
        start[order] = len(ids) + np.cumsum(new) - new
        self.memory.add(h[order], flat, new)
        return pool[_runs(start, length)], length

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin; a null has none."""
        column = column.cast(pa.large_string())
        parts = pc.split_pattern(column, " ")
        size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, owner = parts.flatten(), np.repeat(np.arange(len(column)), size)
        # where two spaces meet, or stand at an end, the marks of a run belong together, and such texts are cut one by one
        odd = pc.fill_null(pc.match_substring(column, MARK), False).to_numpy(zero_copy_only=False).copy()
        odd[owner[pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)]] = True
        coded = flat.filter(pa.array(~odd[owner])).dictionary_encode()
        ids, n = self._plain(coded.dictionary)
        seq, who = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner[~odd[owner]]
        extra = {i: _marked(column[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        if any(extra.values()):
            more = sorted({x for own in extra.values() for x in own})
            got = self.encode_words(more)
            place = {x: len(n) + i for i, x in enumerate(more)}
            ids = np.concatenate([ids, np.fromiter((i for x in got for i in x), np.uint16)])
            n = np.concatenate([n, [len(x) for x in got]])
            seq = np.concatenate([seq, np.array([place[x] for own in extra.values() for x in own], np.int64)])
            who = np.concatenate([who, np.repeat(np.array(list(extra), np.int64), [len(own) for own in extra.values()])])
            by = np.argsort(who, kind="stable")
            seq, who = seq[by], who[by]
        total = np.bincount(who, weights=n[seq], minlength=len(column)).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        return ids[_runs((np.cumsum(n) - n)[seq], n[seq])].astype("<i4"), np.concatenate([[0], np.cumsum(total)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        ids, at = self.encode_flat(pa.array(texts, pa.large_string()))
        return [None if t is None else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, each with the space before its first word, and where each one's begin."""
        size = self.raw_size[ids]
        return self.raw[_runs(self.raw_at[ids], size)], np.concatenate([[0], np.cumsum(size)])[at]

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        if ids is None:
            return None
        ids = np.asarray(ids, np.int64)
        return _text(self.decode_flat(ids, np.array([0, len(ids)]))[0].tobytes())


def _text(raw: bytes) -> str:
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _marked(text: str | None) -> list[str]:
    """Marked words: runs of marks with what follows."""
    if not text:
        return []
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + SLICE, side="right")))
        yield batch.slice(a, b - a)
        a = b


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            for part in _slices(batch, 1):
                ids, at = own.encode_flat(part.column(1))
                gone = part.column(1).is_null()
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=gone if part.column(1).null_count else None)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(w.released(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [own.decode(x.values.to_numpy() if x.is_valid else None) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(w.released(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id alone if not given) with n_tokens, ids_sha256 (little-endian 32-bit ids) and round_trip."""
    keep = [id_col] if keep is None else keep
    names = [f"c{i}" for i in range(len(keep))]
    inner = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        own = codec(model)
        for batch in batches:
            for part in _slices(batch, len(names)):
                column = part.column(len(names))
                ids, at = own.encode_flat(column)
                packed, begin = memoryview(ids.astype("<i4").tobytes()), at.tolist()
                sha = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(begin, begin[1:], strict=False)]
                back, to = own.decode_flat(ids, at)
                raw, off = w.utf8(column)
                back, raw, to, off = memoryview(back.tobytes()), memoryview(raw.tobytes()), to.tolist(), off.tolist()
                same = []
                for i in range(part.num_rows):
                    x = back[to[i] : to[i + 1]]
                    same.append(x[1:] == raw[off[i] : off[i + 1]] if x[:1] == b" " else _text(x.tobytes()) == raw[off[i] : off[i + 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=[*names, "n_tokens", "ids_sha256", "round_trip"])

    schema = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for c, x in zip(keep, names, strict=True))
    out, taken = inner.mapInArrow(w.released(run), f"{schema}n_tokens long, ids_sha256 string, round_trip boolean"), {"n_tokens", "ids_sha256", "round_trip"}
    shown = []
    for c in keep:  # a kept column that is named like a result gets a line at its end
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        shown.append(c)
    return out.toDF(*shown, "n_tokens", "ids_sha256", "round_trip")
