"""Scans of DOCX and XLSX files: body items with tables and merged ranges, sheets with typed cells, merged ranges and declared tables.

Files come as whole binary values (a zip has its index at the end), one to a row, and are parsed in the workers; what they hold comes out
as rows, so everything after the scan is relational. A file that is no such archive gives one row with its error and nothing else.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Number formats of dates and times that need no definition.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
DOCX_SCHEMA = "path string, error string, ord int, kind string, style string, list_level int, text string, rows array<array<string>>, ranges array<struct<r1:int,c1:int,r2:int,c2:int>>"
XLSX_SCHEMA = "path string, error string, sheet string, kind string, r1 int, c1 int, r2 int, c2 int, type string, text string"


def _val(node, path: str, attr: str = "val") -> str | None:
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(_W + attr, "")


def _said(p) -> str:
    """Text of a paragraph: runs, tabs and breaks."""
    out = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _lines(text: str) -> str:
    return "\n".join(re.sub(r"[\t\f\v ]+", " ", x).strip() for x in text.split("\n")).strip("\n")


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("word/styles.xml"))
    return {s.get(_W + "styleId", ""): _val(s, _W + "name") or "" for s in root.findall(_W + "style")}


def docx_table(tbl) -> tuple[list[list[str]], list[tuple[int, int, int, int]]]:
    """(rows, merged ranges): the grid with each merged cell's text at its first place and empty below and beside it."""
    rows: list[list[str]] = []
    spans: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for r, tr in enumerate(tbl.findall(_W + "tr"), 1):
        row, c = [], 1
        skip = int(_val(tr, f"{_W}trPr/{_W}gridBefore") or 0)
        row += [""] * skip
        c += skip
        for tc in tr.findall(_W + "tc"):
            wide = max(1, int(_val(tc, f"{_W}tcPr/{_W}gridSpan") or 1))
            merge = _val(tc, f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(t for t in (_lines(_said(p)) for p in tc.findall(_W + "p")) if t)
            going = merge is not None and merge != "restart" and c in open_
            if going:
                open_[c][2] = r
                text = ""
            else:
                open_.pop(c, None)
                box = [r, c, r, c + wide - 1]
                spans.append(box)
                if merge == "restart":
                    open_[c] = box
            row += [text] + [""] * (wide - 1)
            c += wide
        rows.append(row)
    width = max(map(len, rows), default=0)
    ranges = [tuple(s) for s in spans if (s[0], s[1]) != (s[2], s[3])]
    return [x + [""] * (width - len(x)) for x in rows], ranges


def docx_items(data: bytes) -> Iterator[tuple]:
    """(ord, kind, style, list_level, text, rows, ranges) of paragraphs and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = _styles(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        for i, x in enumerate(body if body is not None else (), 1):
            if x.tag == _W + "p":
                style = names.get(_val(x, f"{_W}pPr/{_W}pStyle") or "", _val(x, f"{_W}pPr/{_W}pStyle") or "")
                listed = x.find(f"{_W}pPr/{_W}numPr")
                level = int(_val(listed, _W + "ilvl") or 0) if listed is not None else 0 if style.lower().startswith("list") else None
                yield i, "paragraph", style, level, _lines(_said(x)), [], []
            elif x.tag == _W + "tbl":
                rows, ranges = docx_table(x)
                yield i, "table", None, None, None, rows, ranges


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    c = 0
    for x in letters:
        c = c * 26 + ord(x) - 64
    return int(digits), c


def _box(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    return (*_place(a), *_place(b or a))


def _dates(z: zipfile.ZipFile) -> list[bool]:
    """By style: whether its numbers are dates."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(_S + "numFmt")}
    ids = [int(x.get("numFmtId", 0)) for x in root.findall(f"{_S}cellXfs/{_S}xf")]
    return [i in _DATE_FORMATS or bool(re.search("[ymdhs]", own.get(i, ""), re.IGNORECASE)) for i in ids]


def number_text(value: str, is_date: bool) -> str:
    """A stored number: dates in ISO form (a midnight is a day), whole numbers without a fraction."""
    x = float(value)
    if is_date:
        t = datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))
        return t.date().isoformat() if (t.hour, t.minute, t.second) == (0, 0, 0) else t.isoformat()
    return str(int(x)) if x.is_integer() else repr(x)


def xlsx_items(data: bytes) -> Iterator[tuple]:
    """(sheet, kind, r1, c1, r2, c2, type, text): kind cell, merge or table of every sheet that is shown. Type f is a formula, of which the
    stored value is the text; of a table the text is the number of its header rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        dates = _dates(z)

        def targets(path: str) -> dict[str, str]:
            folder, _, name = path.rpartition("/")
            rels = f"{folder}/_rels/{name}.rels"
            if rels not in names:
                return {}
            out = {}
            for x in ElementTree.fromstring(z.read(rels)).findall(_P + "Relationship"):
                t = x.get("Target", "")
                parts = t.lstrip("/").split("/") if t.startswith("/") else [*folder.split("/"), *t.split("/")]
                clean: list[str] = []
                for p in parts:
                    if p == "..":
                        clean.pop()
                    elif p != ".":
                        clean.append(p)
                out[x.get("Id", "")] = "/".join(clean)
            return out

        book = targets("xl/workbook.xml")
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
            path = book.get(s.get(_R + "id", ""))
            if s.get("state", "visible") != "visible" or path not in names:
                continue
            sheet, root = s.get("name", ""), ElementTree.fromstring(z.read(path))
            for c in root.iter(_S + "c"):
                r, col = _place(c.get("r"))
                v, kind = c.find(_S + "v"), c.get("t", "n")
                text = v.text if v is not None and v.text is not None else ""
                if kind == "s":
                    text = shared[int(text)] if text else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_S + "t"))
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE" if text else ""
                elif kind == "n" and text:
                    style = int(c.get("s", 0))
                    text = number_text(text, style < len(dates) and dates[style])
                formula = c.find(_S + "f") is not None
                if text or formula:
                    yield sheet, "cell", r, col, r, col, "f" if formula else kind, text
            for m in root.iter(_S + "mergeCell"):
                yield sheet, "merge", *_box(m.get("ref")), None, None
            for t in sorted(x for x in targets(path).values() if "/tables/" in x and x in names):
                table = ElementTree.fromstring(z.read(t))
                yield sheet, "table", *_box(table.get("ref")), None, table.get("headerRowCount", "1")


def _scan(files: DataFrame, schema: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in re.sub("<.*?>+", "", schema).split(",")]

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows = [(path, None, *x) for x in parse(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows = [(path, f"{type(e).__name__}: {e}", *[None] * (len(names) - 2))]
                out = pd.DataFrame(rows, columns=names)
                for c in ("ord", "list_level", "r1", "c1", "r2", "c2"):
                    if c in out:
                        out[c] = out[c].astype("Int32")
                if "ranges" in out:
                    out["ranges"] = [None if x is None else [dict(zip(("r1", "c1", "r2", "c2"), y, strict=True)) for y in x] for x in out["ranges"]]
                yield out

    return files.select("path", "content").mapInPandas(run, schema)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def docx(files: DataFrame) -> DataFrame:
    """path, error, ord, kind, style, list_level, text, rows, ranges of files (path, content)."""
    return _scan(files, DOCX_SCHEMA, docx_items)


def xlsx(files: DataFrame) -> DataFrame:
    """path, error, sheet, kind, r1, c1, r2, c2, type, text of files (path, content)."""
    return _scan(files, XLSX_SCHEMA, xlsx_items)


def docx_cells(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, ranges) of the tables, keyed by path and ord, as the table operators take them."""
    t = items.where("kind = 'table'")
    rows = t.select("path", "ord", F.posexplode("rows").alias("r", "row"))
    cells = rows.select("path", "ord", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "text")).select("path", "ord", "r", (F.col("c") + 1).alias("c"), "text")
    return cells, t.select("path", "ord", F.explode("ranges").alias("x")).select("path", "ord", "x.*")


def xlsx_cells(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, ranges, tables) keyed by path and sheet."""
    of = lambda k: items.where(F.col("kind") == k)
    cells = of("cell").select("path", "sheet", F.col("r1").alias("r"), F.col("c1").alias("c"), F.col("type").alias("kind"), "text")
    return cells, of("merge").select("path", "sheet", "r1", "c1", "r2", "c2"), of("table").select("path", "sheet", "r1", "c1", "r2", "c2", F.col("text").cast("int").alias("header_count"))
