"""Formats, merges, comments and order of sheets; groups, tables and notes of slides; older formats; spans without a limit."""

import zipfile

import pytest

from concord.sources.office import read_office
from concord.sources.sheets import from_serial, is_date_format, raw_sheets, read_sheets

SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def rel(i, kind, target):
    return f'<Relationship Id="{i}" Type="{KIND}/{kind}" Target="{target}"/>'


@pytest.mark.parametrize(("pattern", "is_date"), [("yyyy-mm-dd", True), ("0.00", False), ('0 "days"', False), ("[Red]0.0", False), ("[h]:mm", True), ("General", False), (None, False), ("0\\h", False), ("d-mmm", True)])
def test_date_formats(pattern, is_date):
    assert is_date_format(pattern) is is_date


def test_serials():
    assert from_serial(45000) == ("2023-03-15", "date") and from_serial(45000.5) == ("2023-03-15T12:00:00", "datetime") and from_serial(0.25) == ("06:00:00", "time")
    assert from_serial(1) == ("1900-01-01", "date") and from_serial(61) == ("1900-03-01", "date") and from_serial(0, True) == ("1904-01-01", "date")


def test_sheets_with_formats(spark, tmp_path):
    styles = f"""<styleSheet {SHEET}><numFmts><numFmt numFmtId="170" formatCode="0.0 &quot;mm&quot;"/></numFmts>
      <fonts><font><sz val="11"/></font><font><b/><sz val="14"/></font><font><b val="0"/></font></fonts>
      <fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="ffffc000"/></patternFill></fill></fills>
      <cellXfs><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="170" fontId="1" fillId="1"/><xf numFmtId="14" fontId="2" fillId="0"/></cellXfs></styleSheet>"""
    first = f"""<worksheet {SHEET}><sheetData>
      <row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t><t>line</t></is></c></row>
      <row r="3"><c r="A3" s="2"><v>45000</v></c><c t="b"><v>1</v></c><c r="D3"><v>7</v></c><c r="E3"><v>7.50</v></c><c r="F3" t="e"><v>#N/A</v></c><c r="G3" t="str"><v>of a formula</v></c><c r="H3" s="1"/></row>
      </sheetData><mergeCells count="1"><mergeCell ref="A1:C2"/></mergeCells></worksheet>"""
    write(tmp_path / "b.xlsx", {
        "xl/workbook.xml": f'<workbook {SHEET}><sheets><sheet name="Second" sheetId="2" r:id="rId2"/><sheet name="First" sheetId="1" r:id="rId1" state="hidden"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(rel("rId1", "worksheet", "worksheets/sheet1.xml") + rel("rId2", "worksheet", "/xl/worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": f"<sst {SHEET}><si><r><t>Ti</t></r><r><t>tle</t></r></si></sst>", "xl/styles.xml": styles,
        "xl/worksheets/sheet1.xml": first, "xl/worksheets/sheet2.xml": f'<worksheet {SHEET}><sheetData><row><c><v>1</v></c><c><v>1E2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": RELS.format(rel("rId1", "comments", "../comments1.xml")),
        "xl/comments1.xml": f'<comments {SHEET}><commentList><comment ref="D3"><text><r><t>check </t></r><r><t>this</t></r></text></comment></commentList></comments>',
    })
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    cells = read_sheets(spark, str(tmp_path))
    rows = cells.collect()
    got = {r["address"]: r for r in rows if r["sheet"] == "First"}
    assert {a: (r["value"], r["value_type"]) for a, r in got.items()} == {"A1": ("Title", "str"), "B1": ("inline", "str"), "A3": ("2023-03-15", "date"), "B3": ("True", "bool"), "D3": ("7", "int"), "E3": ("7.5", "float"), "F3": ("#N/A", "error"), "G3": ("of a formula", "str")}
    a1 = got["A1"]
    assert (a1["number_format"], a1["font_bold"], a1["font_size"], a1["fill_color"], a1["merged_range"], a1["is_merged_anchor"]) == ('0.0 "mm"', True, 14.0, "FFFFC000", "A1:C2", True)
    assert (got["B1"]["merged_range"], got["B1"]["is_merged_anchor"], got["B1"]["number_format"], got["D3"]["comment"], got["A3"]["font_bold"]) == ("A1:C2", False, None, "check this", False)
    assert [(r["sheet"], r["sheet_no"], r["address"], r["value"], r["value_type"]) for r in rows if r["sheet_no"] == 1] == [("Second", 1, "A1", "1", "int"), ("Second", 1, "B1", "100.0", "float")]
    assert [r["doc"] for r in rows if r["error"]] == ["c.xlsx"]
    sheet = {r["sheet"]: r for r in raw_sheets(cells).collect()}["First"]
    assert (sheet["used_range"], sheet["n_cells"], sheet["hidden"], sheet["bold"]) == ("A1:G3", 8, True, ["A1"])
    assert [tuple(x) for x in sheet["merged"]] == [("A1:C2", "Title")] and [tuple(x) for x in sheet["comments"]] == [("D3", "check this")] and [tuple(x) for x in sheet["fills"]] == [("A1", "FFFFC000")]


def test_slides_with_groups_tables_and_notes(spark, tmp_path):
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{KIND}"'
    shape = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    cell = lambda t, more="": f"<a:tc {more}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell("H", "gridSpan=\"2\"")}{cell("", "hMerge=\"1\"")}</a:tr><a:tr>{cell("x", "rowSpan=\"2\"")}{cell("y")}</a:tr><a:tr>{cell("", "vMerge=\"1\"")}{cell("z")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = lambda inner: f"<p:sld {ns}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    write(tmp_path / "s.pptx", {
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="rId9"/><p:sldId id="2" r:id="rId8"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("rId8", "slide", "slides/slide1.xml") + rel("rId9", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("last")),
        "ppt/slides/slide2.xml": slide(shape("top") + f"<p:grpSp>{shape('in')}<p:grpSp>{shape('deep')}</p:grpSp></p:grpSp>" + table + shape("")),
        "ppt/slides/_rels/slide2.xml.rels": RELS.format(rel("rId1", "notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {ns}><p:cSld><p:spTree>{shape('7', '<p:ph type=\"sldNum\"/>')}{shape('say this', '<p:ph type=\"body\"/>')}</p:spTree></p:cSld></p:notes>",
    })
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    rows = read_office(spark, str(tmp_path)).collect()
    got = [(r["container"], r["block_id"], r["kind"], r["text"], r["row"], r["col"]) for r in rows if r["doc"] == "s.pptx"]
    assert [g[:4] for g in got if g[2] != "table"] == [(1, "p001_s001", "text", "top"), (1, "p001_s002", "text", "in"), (1, "p001_s003", "text", "deep"), (1, "p001_notes", "notes", "say this"), (2, "p002_s001", "text", "last")]
    assert [g[3:] for g in got if g[2] == "table"] == [("H", 0, 0), ("H", 0, 1), ("x", 1, 0), ("y", 1, 1), ("x", 2, 0), ("z", 2, 1)]
    assert {r["doc"]: "newer format" in r["error"] for r in rows if r["error"]} == {"old.xls": True}
