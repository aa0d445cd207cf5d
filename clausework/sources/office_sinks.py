"""Workbooks and DOCX documents made in the workers, a file to a group, and the files of a relation stored in a folder.

A file is built whole in one task, since a zip has its index at the end, so its size is checked first: no sheet may pass the SHEET_ROWS rows
that the format allows, no document DOCUMENT_ITEMS paragraphs and table rows; larger ones raise a ValueError before any is built. Nulls are empty. Characters that XML cannot hold are left
out. Rows come by ord; of equal ords in any order. Every cell is text, so codes keep leading zeros and nothing is read as a formula.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.sources.store import written

SHEET_ROWS = 1_048_576
DOCUMENT_ITEMS = 1_000_000
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DAY = (1980, 1, 1, 0, 0, 0)


def _x(text) -> str:
    """Escaped text; a carriage return is written out, or XML would read it as a line feed."""
    text = "" if text is None else _UNFIT.sub("", str(text))
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;")


def _zip(parts: dict[str, str]) -> bytes:
    """The same bytes for the same parts, so that a task run twice writes the same file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            info = zipfile.ZipInfo(name, _DAY)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, _HEAD + body)
    return out.getvalue()


def _package(main: str, kinds: dict[str, str]) -> dict[str, str]:
    types = "".join(f'<Override PartName="/{k}" ContentType="{v}"/>' for k, v in kinds.items())
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def column_name(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_names(names: list) -> list[str]:
    """Names that a workbook takes: 31 characters, none of []:*?/\\, each once whatever its case."""
    out: list[str] = []
    used: set[str] = set()
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", _UNFIT.sub("", str(name or ""))).strip("'")[:31] or "Sheet"
        own, i = base, 1
        while own.lower() in used:
            i += 1
            own = f"{base[: 30 - len(str(i))]}_{i}"
        used.add(own.lower())
        out.append(own)
    return out


def xlsx_bytes(sheets: list[tuple[str, list]]) -> bytes:
    """A workbook of (name, rows); empty cells are left out."""
    names = sheet_names([n for n, _ in sheets])
    paths = [f"xl/worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = _package("xl/workbook.xml", {"xl/workbook.xml": f"{kind}sheet.main+xml"} | dict.fromkeys(paths, f"{kind}worksheet+xml"))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{_x(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    for path, (_, rows) in zip(paths, sheets, strict=True):
        body = []
        for r, row in enumerate(rows, 1):
            cells = "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_x(v)}</t></is></c>' for c, v in enumerate(row if row is not None else (), 1) if v is not None and v != "")
            body.append(f'<row r="{r}">{cells}</row>')
        parts[path] = f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(body)}</sheetData></worksheet>'
    return _zip(parts)


def _paragraph(text, style: str | None = None) -> str:
    runs = []
    for piece in re.split("([\n\t])", "" if text is None else str(text)):
        if piece:
            runs.append("<w:br/>" if piece == "\n" else "<w:tab/>" if piece == "\t" else f'<w:t xml:space="preserve">{_x(piece)}</w:t>')
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r>{''.join(runs)}</w:r></w:p>"


def docx_bytes(items: list[tuple]) -> bytes:
    """A document of (kind, style name, text, rows): kind table holds rows, anything else is a paragraph."""
    styles = {n: f"S{i}" for i, n in enumerate(sorted({s for k, s, *_ in items if k != "table" and s}), 1)}
    body = []
    for kind, style, text, rows in items:
        if kind != "table":
            body.append(_paragraph(text, styles.get(style)))
            continue
        rows = [list(r) if r is not None else [] for r in (rows if rows is not None else ())]
        width = max([1, *(len(r) for r in rows)])
        lines = ("".join(f"<w:tc><w:tcPr/>{_paragraph(v)}</w:tc>" for v in r + [""] * (width - len(r))) for r in rows)
        body.append(f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * width}</w:tblGrid>{''.join(f'<w:tr>{x}</w:tr>' for x in lines)}</w:tbl>")
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    parts = _package("word/document.xml", {"word/document.xml": f"{kind}document.main+xml", "word/styles.xml": f"{kind}styles+xml"})
    parts["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>'
    parts["word/styles.xml"] = f'<w:styles xmlns:w="{_WORD}">' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{_x(n)}"/></w:style>' for n, i in styles.items()) + "</w:styles>"
    parts["word/document.xml"] = f'<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
    return _zip(parts)


def _checked(rows: DataFrame, by: list[str], size: Column, limit: int) -> None:
    over = rows.groupBy(*by).agg(F.sum(size).alias("n")).where(F.col("n") > limit).first()
    if over:
        raise ValueError(f"{over.asDict()} is beyond the {limit} rows of a file")


def workbooks(rows: DataFrame) -> DataFrame:
    """path, content of rows (path, sheet, ord, cells: array of strings): one workbook a path, its sheets by name."""
    rows = rows.select("path", F.coalesce("sheet", F.lit("")).alias("sheet"), "ord", "cells")
    _checked(rows, ["path", "sheet"], F.lit(1), SHEET_ROWS)

    def build(key, df):
        df = df.sort_values(["sheet", "ord"], kind="stable")
        return pd.DataFrame({"path": [key[0]], "content": [xlsx_bytes([(n, list(x["cells"])) for n, x in df.groupby("sheet", sort=True)])]})

    return rows.groupBy("path").applyInPandas(build, "path string, content binary")


def documents(items: DataFrame) -> DataFrame:
    """path, content of items (path, ord, kind, style, text, rows) as the scan of such files gives them: one document a path."""
    items = items.select("path", "ord", "kind", "style", "text", "rows")
    _checked(items, ["path"], F.greatest(F.lit(1), F.coalesce(F.size("rows"), F.lit(1))), DOCUMENT_ITEMS)

    def build(key, df):
        df = df.sort_values("ord", kind="stable")
        whole = list(zip(*(df[c].tolist() for c in ("kind", "style", "text", "rows")), strict=True))
        return pd.DataFrame({"path": [key[0]], "content": [docx_bytes(whole)]})

    return items.groupBy("path").applyInPandas(build, "path string, content binary")


def stored(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path, content) into a folder that all executors share; path, size of each. A file appears whole or not at all, and a task that runs
    again puts the same bytes there. Paths may not leave the folder."""

    def put(frames):
        if "://" in folder or folder.startswith("file:"):
            fs, root = pafs.FileSystem.from_uri(folder)
        else:
            fs, root = pafs.LocalFileSystem(), folder
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the folder: {path}")
                own = f"{root.rstrip('/')}/{path}"
                fs.create_dir(own.rpartition("/")[0], recursive=True)
                part = f"{own}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as out:
                    out.write(bytes(content))
                fs.move(part, own)
            yield pd.DataFrame({"path": f["path"], "size": [len(x) for x in f["content"]]})

    return written(files.select("path", "content").mapInPandas(put, "path string, size long"), "stored")
