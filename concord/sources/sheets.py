"""Raw cells of Excel files with their formats, comments and merged regions, read from the OOXML parts as a stream.

A cell's style is a chain: cell, format record, and that record's number format, font and fill.  Rows are read one at a time,
so a large sheet is never one tree in memory.  A file that cannot be read gives one row with its error.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column_letters

CELL_SCHEMA = (
    "doc string, sheet string, sheet_no int, hidden boolean, row int, col int, address string, value string, value_type string, number_format string, "
    "font_bold boolean, font_size double, fill_color string, comment string, merged_range string, is_merged_anchor boolean, error string"
)
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Number formats that files name by number alone.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_DATE = re.compile(r"[ymdhs]", re.IGNORECASE)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General', re.IGNORECASE)


def is_date_format(pattern: str | None) -> bool:
    """Whether a number format shows a date or a time: it has a letter of one outside quotes, escapes and colours."""
    return bool(pattern and _DATE.search(_QUOTED.sub("", pattern.split(";")[0])))


def from_serial(serial: float, since_1904: bool = False) -> tuple[str, str]:
    """(ISO text, value type) of a date serial: a date, a date with time, or a time of day below 1."""
    days, second = divmod(round(serial * 86_400), 86_400)
    time = (datetime.datetime.min + datetime.timedelta(seconds=second)).time()
    if days == 0 and not since_1904:
        return time.isoformat(), "time"
    # 1900 has a leap day in this calendar that never was; serials below 60 lie before it
    epoch = datetime.date(1904, 1, 1) if since_1904 else datetime.date(1899, 12, 30 if days >= 60 else 31)
    day = epoch + datetime.timedelta(days=days)
    return (datetime.datetime.combine(day, time).isoformat(), "datetime") if second else (day.isoformat(), "date")


def letters(col: int) -> str:
    out = ""
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def place(address: str) -> tuple[int, int]:
    """(row, column) of an address."""
    name, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", address.replace("$", "")).groups()
    col = 0
    for ch in name:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


class _Book:
    """Parts of one file: sheets in the workbook's order, shared texts, styles."""

    def __init__(self, data: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.archive.namelist())
        self.shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in self._tree("xl/sharedStrings.xml").findall(f"{_S}si")]
        styles = self._tree("xl/styles.xml")
        own = {int(n.get("numFmtId")): n.get("formatCode") for n in styles.iter(f"{_S}numFmt")}
        fonts = [(self._flag(f.find(f"{_S}b")), self._number(f.find(f"{_S}sz"))) for f in styles.findall(f"{_S}fonts/{_S}font")]
        fills = [self._colour(f) for f in styles.findall(f"{_S}fills/{_S}fill")]
        at = lambda x, name, table, none: table[k] if (k := int(x.get(name, "0"))) < len(table) else none
        self.formats = [(own.get(k := int(x.get("numFmtId", "0"))) or FORMATS.get(k), *at(x, "fontId", fonts, (None, None)), at(x, "fillId", fills, None)) for x in styles.findall(f"{_S}cellXfs/{_S}xf")]
        book = self._tree("xl/workbook.xml")
        since = book.find(f"{_S}workbookPr")
        self.since_1904 = since is not None and since.get("date1904") in ("1", "true")
        targets = self._relations("xl/workbook.xml")
        self.sheets = [(s.get("name"), s.get("state", "visible") != "visible", targets.get(s.get(f"{_R}id"), (None, None))[1]) for s in book.findall(f"{_S}sheets/{_S}sheet")]
        if not self.sheets:  # no workbook part: the sheets there are, by number
            parts = sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
            self.sheets = [(f"Sheet{k}", False, n) for k, n in parts]

    def _tree(self, name: str) -> ET.Element:
        return ET.fromstring(self.archive.read(name)) if name in self.names else ET.Element("none")

    def _relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id to (kind, part)."""
        folder, name = posixpath.split(part)
        return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("/" if r.get("Target").startswith("/") else folder, r.get("Target").lstrip("/"))).lstrip("/")) for r in self._tree(f"{folder}/_rels/{name}.rels").findall(f"{_P}Relationship")}

    @staticmethod
    def _flag(node: ET.Element | None) -> bool:
        return node is not None and node.get("val", "1") not in ("0", "false")

    @staticmethod
    def _number(node: ET.Element | None) -> float | None:
        return float(node.get("val")) if node is not None and node.get("val") else None

    @staticmethod
    def _colour(fill: ET.Element) -> str | None:
        """The colour of a solid fill as ARGB; theme and indexed colours are not resolved."""
        pattern = fill.find(f"{_S}patternFill")
        front = pattern.find(f"{_S}fgColor") if pattern is not None and pattern.get("patternType") == "solid" else None
        return front.get("rgb").upper() if front is not None and front.get("rgb") else None

    def comments(self, part: str) -> dict[str, str]:
        return {c.get("ref"): "".join(t.text or "" for t in c.iter(f"{_S}t")) for kind, target in self._relations(part).values() if kind == "comments" for c in self._tree(target).iter(f"{_S}comment")}

    def merged(self, part: str) -> list[str]:
        """Merged regions, which stand behind the rows: the rows are let go as they pass."""
        found = []
        with self.archive.open(part) as stream:
            for _, node in ET.iterparse(stream):
                if node.tag == f"{_S}mergeCell":
                    found.append(node.get("ref").replace("$", ""))
                elif node.tag == f"{_S}row":
                    node.clear()
        return found

    def _value(self, cell: ET.Element, pattern: str | None) -> tuple[str, str] | None:
        """(text, type) of a cell; None for an empty one."""
        kind, node, inline = cell.get("t", "n"), cell.find(f"{_S}v"), cell.find(f"{_S}is")
        if inline is not None:
            return ("".join(t.text or "" for t in inline.iter(f"{_S}t")), "str")
        if node is None or node.text is None:
            return None
        if kind == "s":
            return self.shared[int(node.text)], "str"
        if kind == "b":
            return ("True" if node.text.strip() == "1" else "False"), "bool"
        if kind in ("str", "e", "d"):
            return node.text, {"e": "error", "d": "datetime"}.get(kind, "str")
        number = float(node.text)
        if is_date_format(pattern) and number >= 0:
            return from_serial(number, self.since_1904)
        return (str(int(number)), "int") if number.is_integer() and "." not in node.text and "E" not in node.text.upper() else (repr(number), "float")

    def cells(self, part: str) -> Iterator[tuple]:
        """Full cells, row by row, with what their style says."""
        notes, regions = self.comments(part), self.merged(part)
        bounds = [(ref, *place(ref.split(":")[0]), *place(ref.split(":")[-1])) for ref in regions]
        # regions by the rows they touch: a cell looks only at those of its row
        by_row: dict[int, list] = {}
        for ref, r1, c1, r2, c2 in bounds:
            for r in range(r1, r2 + 1):
                by_row.setdefault(r, []).append((c1, c2, ref, r1))
        with self.archive.open(part) as stream:
            row = 0
            for _, node in ET.iterparse(stream):
                if node.tag != f"{_S}row":
                    continue
                row, col = int(node.get("r", row + 1)), 0
                for cell in node.findall(f"{_S}c"):
                    row, col = place(cell.get("r")) if cell.get("r") else (row, col + 1)
                    style = int(cell.get("s", "0"))
                    pattern, bold, size, fill = self.formats[style] if style < len(self.formats) else (None, None, None, None)
                    value, address = self._value(cell, pattern), f"{letters(col)}{row}"
                    if value is None or value[0] == "":
                        continue
                    region = next(((ref, r1 == row and c1 == col) for c1, c2, ref, r1 in by_row.get(row, ()) if c1 <= col <= c2), (None, False))
                    yield row, col, address, *value, pattern if pattern != "General" else None, bold, size, fill, notes.get(address), *region
                node.clear()


def sheet_cells(data: bytes) -> Iterator[tuple]:
    book = _Book(data)
    for number, (name, hidden, part) in enumerate(book.sheets, 1):
        if part in book.names:
            for cell in book.cells(part):
                yield name, number, hidden, *cell


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Full cells of all Excel files (.xlsx, .xlsm) under ``path``: columns of CELL_SCHEMA; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    chosen = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("xlsx", "xlsm") & ~F.startswith(name, F.lit("~$"))).select(name.alias("doc"), "content")
    names = [f.split()[0] for f in CELL_SCHEMA.split(", ")]
    kinds = {"sheet_no": "Int32", "row": "Int32", "col": "Int32", "hidden": "boolean", "font_bold": "boolean", "is_merged_anchor": "boolean", "font_size": "Float64"}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in batch.itertuples(index=False):
                rows = []
                try:
                    for cell in sheet_cells(content):
                        rows.append((doc, *cell, None))
                        if len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=names).astype(kinds)
                            rows = []
                except Exception as error:  # any damage of one file stays with that file
                    rows.append((doc, *[None] * (len(names) - 2), str(error) or type(error).__name__))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(kinds)

    return chosen.mapInPandas(parse, CELL_SCHEMA)


def raw_sheets(cells: DataFrame) -> DataFrame:
    """(doc, sheet, sheet_no, hidden, used_range, n_cells, merged, bold, formats, fills, comments) of raw cells: the range from the first to
    the last full row and column, merged regions with their value, and addresses of what looks special, in order of row and column."""
    at = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("row", "col", value.alias("v"))))), lambda x: x["v"])
    pair = lambda c: F.struct(F.col("address").alias("address"), F.col(c).alias(c))
    per = cells.where("row is not null").groupBy("doc", "sheet", "sheet_no", "hidden").agg(
        F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"), F.count(F.lit(1)).alias("n_cells"),
        at(F.col("is_merged_anchor"), F.struct(F.col("merged_range").alias("range"), F.col("value"))).alias("merged"), at(F.col("font_bold"), F.col("address")).alias("bold"),
        at(F.col("number_format").isNotNull(), pair("number_format")).alias("formats"), at(F.col("fill_color").isNotNull(), pair("fill_color")).alias("fills"), at(F.col("comment").isNotNull(), pair("comment")).alias("comments"),
    )
    corner = lambda c, r: F.concat(column_letters(c), F.col(r).cast("string"))
    return per.withColumn("used_range", F.concat(corner("c1", "r1"), F.lit(":"), corner("c2", "r2"))).drop("r1", "r2", "c1", "c2")
