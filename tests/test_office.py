"""DOCX and XLSX files made here: body order, lists, spans, vertical merges, typed cells, hidden sheets, tables, broken files."""

import io
import zipfile

from clausework.operators import sheets, tables
from clausework.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style="", more=""):
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def tc(text, span=1, merge=None):
    v = "" if merge is None else '<w:vMerge w:val="restart"/>' if merge == "restart" else "<w:vMerge/>"
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{v}</w:tcPr>{p(text)}</w:tc>'


DOCX = archive({
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LP"><w:name w:val="List Paragraph"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body>{p("Scope", "H1")}{p("an  item", "LP")}{p("numbered", "", "<w:numPr><w:ilvl w:val=" + chr(34) + "2" + chr(34) + "/></w:numPr>")}'
    f'<w:tbl><w:tr>{tc("Title", 3)}</w:tr><w:tr>{tc("A", 1, "restart")}{tc("b")}{tc("c")}</w:tr><w:tr>{tc("ignored", 1, "continue")}{tc("d", 2)}</w:tr></w:tbl>{p("end")}<w:sectPr/></w:body></w:document>',
})
XLSX = archive({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="rId1"/><sheet name="Gone" state="hidden" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships {P}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Req ID</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;y&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="b"><v>1</v></c></row><row r="2"><c r="A2"><v>42.0</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2" s="2"><v>45000.5</v></c>'
    '<c r="D2" s="3"><v>1.5</v></c></row><row r="3"><c r="A3"><f>A1+1</f></c><c r="B3" t="str"><f>A1</f><v>shown</v></c><c r="C3" t="inlineStr"><is><t>in line</t></is></c></row><row r="6"><c r="AA6"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells></worksheet>',
    "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {P}><Relationship Id="rId9" Target="../tables/table1.xml"/></Relationships>',
    "xl/tables/table1.xml": f'<table {S} ref="A1:D3" headerRowCount="0"/>',
})


def test_docx_items():
    got = list(office.docx_items(DOCX))
    assert [x[:5] for x in got] == [(1, "paragraph", "heading 1", None, "Scope"), (2, "paragraph", "List Paragraph", 0, "an item"), (3, "paragraph", "", 2, "numbered"), (4, "table", None, None, None), (5, "paragraph", "", None, "end")]
    assert got[3][5] == [["Title", "", ""], ["A", "b", "c"], ["", "d", ""]] and sorted(got[3][6]) == [(1, 1, 1, 3), (2, 1, 3, 1), (3, 2, 3, 3)]


def test_xlsx_items():
    got = list(office.xlsx_items(XLSX))
    assert {(x[2], x[3]): (x[6], x[7]) for x in got if x[1] == "cell"} == {
        (1, 1): ("s", "Req ID"), (1, 2): ("s", "two runs"), (1, 3): ("b", "TRUE"), (2, 1): ("n", "42"), (2, 2): ("n", "2023-03-15"), (2, 3): ("n", "2023-03-15T12:00:00"),
        (2, 4): ("n", "1.5"), (3, 1): ("f", ""), (3, 2): ("f", "shown"), (3, 3): ("inlineStr", "in line"), (6, 27): ("n", "7"),
    }
    assert [x[2:] for x in got if x[1] != "cell"] == [(1, 2, 1, 3, None, None), (1, 1, 3, 4, None, "0")] and {x[0] for x in got} == {"One"}


def test_files_become_tables(spark, tmp_path):
    for name, data in (("a.docx", DOCX), ("b.xlsx", XLSX), ("c.docx", b"no archive"), ("d.xlsx", archive({"x": "y"}))):
        (tmp_path / name).write_bytes(data)
    d = office.docx(office.binary_files(spark, str(tmp_path / "*.docx")))
    assert d.where("error is not null").count() == 1
    cells, ranges = office.docx_cells(d)
    found = tables.facts(cells, ["path", "ord"])
    tabs, _ = tables.structure(found, tables.rows_of(found, ranges, ["path", "ord"]), ["path", "ord"])
    assert [(r.titles, r.header_rows, r.status) for r in tabs.collect()] == [(1, [2], "inferred")]
    x = office.xlsx(office.binary_files(spark, str(tmp_path / "*.xlsx")))
    assert x.where("error is not null").count() == 1
    cells, ranges, declared = office.xlsx_cells(x)
    by = ["path", "sheet"]
    assert [(r.r1, r.c1, r.r2, r.c2) for r in sheets.regions(cells, by).orderBy("r1").collect()] == [(1, 1, 3, 4), (6, 27, 6, 27)]
    assert [(r.r, r.c) for r in sheets.uncached(cells, by, 100).collect()] == [(3, 1)] and declared.first().header_count == 0
    assert {(r.r, r.c): r.text for r in sheets.filled(cells.drop("kind"), ranges, by).collect()}[1, 2] == "two runs"
    assert office.docx(office.binary_files(spark, str(tmp_path / "*.docx")).limit(0)).count() == 0
