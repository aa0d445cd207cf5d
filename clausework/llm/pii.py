r"""Personal data with offset-preserving deobfuscation.

Base detectors find e-mail addresses, IP addresses, card and phone numbers in the text as it is. A chain of transducers then
rewrites the text (homoglyphs and invisible characters, dot disguises, spelled digits, at disguises), each keeping for every output
character the source span it came from; the same detectors run over the normal form and their spans are mapped back. Only spans
that a rewriting took part in and that do not lie within base spans of their kind are added; base spans always stay beside them.

All scans are linear, so texts of any length are taken whole: runs are matched possessively and from their start, where a failing run
cannot match further right either, and blanks around a disguise are added after the match.

Defined results. Null text: no spans, the digest of the empty string. Spans are code points, end exclusive, ordered by kind
(email, ip, card, phone), then start, so there are no ties; redact() takes the leftmost, then longest, of overlapping ones. Rows that
repeat an id, or have none, are judged row by row. Extra columns, whatever their names, are ignored by find() and kept
by redact(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm import _words as w

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Look-alikes of ASCII letters, digits and signs in other scripts.
_ALIKE = str.maketrans("аеорсухіјѕԁһАВЕКМНОРСТХІЅοΑΒΕΗΙΚΜΝΟΡΤΧΥΖ＠．․。", "aeopcyxijsdhABEKMHOPCTXISoABEHIKMNOPTXYZ@...")
_ALIKE |= {0xFF10 + i: chr(48 + i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0x660 + i: chr(48 + i) for i in range(10)}
_HIDDEN = np.array([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD], np.uint32)
_FIRST = _ALIKE | dict.fromkeys(_HIDDEN.tolist())
_ALIKE_CODES = np.array(sorted(_ALIKE), np.uint32)
_DIGITS = {x: str(i) for i, x in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NAME = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[ ]++)?(?:{_NAME}|[0-9]++)(?:[ ,.-]++(?:{_NAME}|[0-9]++)(?![A-Za-z]))++")
_PART = re.compile(rf"(?i){_NAME}|plus[ ]+|[0-9]+")
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
#: The blanks around belong to the disguise too; _wide() adds them.
_AT = re.compile(rf"(?i){_OPEN}\s*+(?:at|@)\s*+{_CLOSE}")
_DOT = re.compile(rf"(?i){_OPEN}\s*+(?:dot|\.)\s*+{_CLOSE}")
#: Looked for when the dots are resolved; a host with no dot made must end in letters.
_SAID = re.compile(r"(?i)(?<=[A-Za-z0-9])\s++at\s++(?=([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++))")
_LETTERS_LAST = re.compile(r"\.[A-Za-z]{2,}\Z")
_SAID_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9])")
_CUE = re.compile(rf"(?i){_OPEN}\s*+(?:at|dot|@|\.)\s*+{_CLOSE}|\sdot\s|\sat\s++[a-z0-9-]++\.[a-z0-9]|(?<![a-z])(?:{_NAME})[ ,.-]++(?:{_NAME}|[0-9])|[Ͱ-ԯ٠-٩！-～​-‍․⁠﻿­。]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    at = t.find("@")
    while at >= 0:
        a = at
        while a > pos and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at) if a < at else None
        if m:
            out.append((a, m.end()))
        pos = m.end() if m else at + 1
        at = t.find("@", pos)
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base detectors, ordered."""
    out = [(0, a, b) for a, b in _emails(t)] if "@" in t else []
    if "." in t:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in t:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= sum("0" <= x <= "9" for x in m[0]) <= 15]
    return out


class _Form:
    """A text with, for each character, the source span it stands for and whether a rewriting made it."""

    def __init__(self, text: str):
        """The first transducer at once, as it works character by character: hidden ones go, look-alikes become what they look like."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = ~np.isin(codes, _HIDDEN)
        self.text = text.translate(_FIRST)
        self.start = np.flatnonzero(seen)
        self.end, self.made = self.start + 1, np.isin(codes, _ALIKE_CODES)[seen]

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replaces each (start, end, new); a new character stands for the whole span."""
        if not spans:
            return
        text, start, end, made, at = [], [], [], [], 0
        for a, b, new in spans:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            made += [self.made[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])
        self.made = np.concatenate([*made, self.made[at:]])


def _wide(t: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches with the blanks around them, but for those that the match before has."""
    done = 0
    for m in pattern.finditer(t):
        a, b = m.span()
        while a > done and t[a - 1].isspace():
            a -= 1
        while b < len(t) and t[b].isspace():
            b += 1
        yield a, b
        done = b


def _spelled(t: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(t):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _PART.finditer(t, m.start(), m.end())]
        if sum(p[2] in _DIGITS for p in parts) < (1 if m[0].count(".") >= 3 else 3):
            continue
        for i, (a, b, x) in enumerate(parts):
            dotted = "." in t[b : parts[i + 1][0]] if i + 1 < len(parts) else False
            stop = parts[i + 1][0] if i + 1 < len(parts) and not dotted else b
            out.append((a, stop, "+" if x.startswith("plus") else _DIGITS.get(x, x)))
    return out


def _within(x: int, y: int, spans: list[tuple[int, int]]) -> bool:
    """Whether spans, in order and apart, cover all from x to y."""
    i = max(0, bisect_right(spans, (x, math.inf)) - 1)
    while x < y and i < len(spans) and spans[i][0] <= x:
        x, i = max(x, spans[i][1]), i + 1
    return x >= y


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order, without those that begin within one before."""
    out: list[tuple[int, int, str]] = []
    for x in sorted(spans):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def added_spans(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not _CUE.search(t):
        return []
    form = _Form(t)
    form.rewrite(_apart([(a, b, ".") for a, b in _wide(form.text, _DOT)] + [(*m.span(), ".") for m in _SAID_DOT.finditer(form.text)]))
    form.rewrite(_spelled(form.text))
    said = [(m.start(), m.end(), "@") for m in _SAID.finditer(form.text) if form.made[m.start(1) : m.end(1)].any() or _LETTERS_LAST.search(m[1])]
    form.rewrite(_apart([(a, b, "@") for a, b in _wide(form.text, _AT)] + said))
    of, out = [[(a, b) for k, a, b in base if k == kind] for kind in range(len(KINDS))], []
    for kind, a, b in base_spans(form.text):
        x, y = int(form.start[a]), int(form.end[b - 1])
        new = form.made[a:b].any() or (form.end[a : b - 1] < form.start[a + 1 : b]).any()  # or a sign was taken out
        if new and not _within(x, y, of[kind]):
            out.append((kind, x, y))
    return out


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text) if text else []
    return base, sorted(base + added_spans(text, base)) if text else []


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all)."""

    def run(batches):
        for batch in batches:
            rows = [spans_of(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_said(a) for _, a in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(w.released(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """The text with each span of personal data replaced by its kind in brackets; the leftmost, then longest, of overlapping spans."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in spans_of(text)[1]), key=lambda x: (x[0], -x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, without personal data; size_col, where there is one, follows the text."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(w.released(run), docs.schema)
    if size_col in names:
        out = out.withColumn(size_col, F.length(f"`{text_col}`").cast(docs.schema[size_col].dataType))
    return out
