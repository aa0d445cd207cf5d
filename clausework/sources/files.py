"""Scans and sinks: JSON Lines (strict, tolerant, with a torn tail, caches of two formats), HTML blocks, guarded CSV, Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions.records import formula_safe
from clausework.functions.scalars import clean

BOM = "﻿"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON Lines. Tolerant: lines that are not of the schema come out in _bad; strict: they fail the scan."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def recover_torn_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON Lines whose writer may have been stopped: the last line of a file may be broken if no line feed ends it.

    Any other broken line is an error. Files are read line by line; whether one ends with a line feed is told by its size: the lines and a line feed for each make one
    byte more if it does not, and three less if the reader took a byte order mark away.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_size"), place.alias("_at"), "value")
    ends = lines.groupBy("_f").agg(F.max("_at").alias("_last"), (F.sum(F.octet_length("value") + 1) - F.max("_size")).isin(1, -2).alias("_open"))
    text = F.trim(F.regexp_replace(F.regexp_replace("value", f"^{BOM}", ""), r"\r$", ""))
    rows = lines.join(ends, "_f").withColumn("_t", text).where("_t <> ''").withColumn("_row", F.from_json("_t", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    torn = F.col("_open") & (F.col("_at") == F.col("_last"))
    broken = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    keep = F.when(~broken, True).when(torn, False).otherwise(F.raise_error(F.concat(F.lit("broken line in "), "_f")).cast("boolean"))
    return rows.where(keep).select("_row.*").drop("_bad")


def newest_of_two_formats(rows: DataFrame, order: str, version: str) -> DataFrame:
    """fingerprint, body: the last row of each fingerprint; of the stated schema the payload, else the row itself (both JSON).

    rows: fingerprint, schema, payload, raw and the order. Rows without a fingerprint are left out.
    """
    body = F.when((F.col("schema") == version) & F.startswith(F.trim("payload"), F.lit("{")), F.col("payload")).otherwise(F.col("raw"))
    return rows.where("fingerprint <> ''").groupBy("fingerprint").agg(F.max_by(body, F.col(order)).alias("body"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes or appends JSON Lines; the number of rows."""
    df.write.mode("append" if append else "overwrite").json(path)
    return df.count()


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV in the stated column order whose strings no spreadsheet runs as formulas; columns that df lacks are empty."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    safe = [formula_safe(F.col(c)).alias(c) if kinds.get(c) == "string" else F.col(c) if c in kinds else F.lit("").alias(c) for c in columns]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """section, ord, line: an export by requirement type, a heading before the rows of each; write it in order of section, ord."""
    kind = F.coalesce(F.nullif(F.col("requirement_type"), F.lit("")), F.lit("unknown"))
    line = F.concat(F.lit("- `"), "req_id", F.lit("` "), "requirement", F.lit(" (confidence: "), F.col("confidence").cast("string"), F.lit(", status: "), "review_status", F.lit(", source: "), "source_refs", F.lit(")"))
    body = rows.select(kind.alias("section"), F.col("req_id").alias("ord"), line.alias("line"))
    return body.unionByName(body.groupBy("section").agg(F.lit("").alias("ord")).select("section", "ord", F.concat(F.lit("## "), "section").alias("line")))


def format_rows(requirements: DataFrame, states: DataFrame) -> DataFrame:
    """Requirements with review_status: of the stable id, else of the id, else candidate. states: id, status."""
    s = states.select(F.col("id").alias("_s"), F.col("status").alias("_a"))
    r = states.select(F.col("id").alias("_r"), F.col("status").alias("_b"))
    out = requirements.join(s, F.col("stable_req_id") == F.col("_s"), "left").join(r, F.col("req_id") == F.col("_r"), "left")
    return out.withColumn("review_status", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), F.lit("candidate"))).drop("_s", "_a", "_r", "_b")


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Blocks(HTMLParser):
    """Headings, paragraphs and tables in the order in which they open, each with the text of everything within it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.quiet = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "p" and any(x == "p" for x, _ in self.open):
            self.handle_endtag("p")  # a paragraph ends where the next one begins
        self.quiet += tag in ("script", "style", "noscript")
        block = None
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "table"):
            block = {"kind": tag, "text": [], "rows": []}
            self.blocks.append(block)
        table = next((b for t, b in reversed(self.open) if t == "table"), None)
        if table is not None and tag == "tr":
            table["rows"].append([])
        if table is not None and tag in ("td", "th"):
            if not table["rows"]:
                table["rows"].append([])
            block = {"kind": "cell", "text": [], "rows": []}
            table["rows"][-1].append((tag, block))
        self.open.append((tag, block))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.quiet -= sum(t in ("script", "style", "noscript") for t, _ in self.open[i:])
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.quiet:
            for _, block in self.open:
                if block is not None:
                    block["text"].append(data)


def _plain(block: dict) -> str:
    return re.sub(r"\s+", " ", "".join(block["text"])).strip()


def blocks_of(html: str | None) -> list[tuple[int, str, int | None, str, list[str], list[list[str]]]]:
    """(order, type, level, text, section path, table rows); blocks without text are left out, and cells of a row stand td before th."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    out, sections = [], {}
    for b in parser.blocks:
        kind, text = b["kind"], _plain(b)
        if kind == "table":
            rows = [[_plain(c) for t, c in r if t == "td"] + [_plain(c) for t, c in r if t == "th"] for r in b["rows"]]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                out.append((len(out) + 1, "table", None, "HTML table", [sections[x] for x in sorted(sections)], [r + [""] * (width - len(r)) for r in rows]))
        elif text:
            level = int(kind[1]) if kind != "p" else None
            if level:
                sections = {k: v for k, v in sections.items() if k < level} | {level: text}
            out.append((len(out) + 1, "heading" if level else "paragraph", level, text, [sections[x] for x in sorted(sections)], []))
    return out


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, ord, type, level, text, section_path, rows (of tables): the blocks of each page, in Arrow batches."""
    names = ["id", "ord", "type", "level", "text", "section_path", "rows"]

    def run(frames):
        for f in frames:
            rows = [(i, *b) for i, h in zip(f["id"], f["html"], strict=True) for b in blocks_of(h)]
            yield pd.DataFrame(rows, columns=names).astype({"level": "Int32"})

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ord int, type string, level int, text string, section_path array<string>, rows array<array<string>>"
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, schema)


def cells_of(blocks: DataFrame) -> DataFrame:
    """id, ord, r, c, text: the table blocks as cells."""
    rows = blocks.where("type = 'table'").select("id", "ord", F.posexplode("rows").alias("r", "row"))
    return rows.select("id", "ord", (F.col("r") + 1).alias("r"), F.posexplode("row").alias("c", "x")).select("id", "ord", "r", (F.col("c") + 1).alias("c"), clean(F.col("x")).alias("text"))
