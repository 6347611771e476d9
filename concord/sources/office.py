"""Blocks of Word, slides of PowerPoint and cells of Excel files, read from their OOXML parts.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do; each file is parsed in one task.
A file that cannot be read gives one row with its error instead of failing the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sheets import sheet_cells

BLOCK_SCHEMA = "doc string, doc_type string, container int, ord int, block_id string, kind string, style string, text string, row int, col int, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Extensions by type of document, and older ones of which no part can be read.
TYPES = {"xlsx": "excel", "xlsm": "excel", "docx": "word", "pptx": "ppt"}
OLDER = ("xls", "doc", "ppt")


def _tidy(text: str) -> str:
    return " ".join(text.split())


def _word_text(node) -> str:
    parts = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
    return "".join(parts[n.tag](n) for n in node.iter() if n.tag in parts)


def _table_cells(table) -> Iterator[tuple[int, int, str]]:
    """Cells of a Word table: spans repeat to the right; a vertical merge goes on below the cell that starts it, and a
    continuation under a cell that is not merged is empty."""
    merged: dict[int, str] = {}
    for r, row in enumerate(table.findall(f"{_W}tr")):
        c = 0
        for cell in row.findall(f"{_W}tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            text = _tidy("\n".join(_word_text(p) for p in cell.findall(f"{_W}p")))
            goes_on = merge is not None and merge.get(f"{_W}val") != "restart"
            if goes_on:
                text = merged.get(c, "")
            for _ in range(max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1):
                if merge is None:
                    merged.pop(c, None)
                else:
                    merged[c] = text
                yield r, c, text
                c += 1


def word_blocks(data: bytes) -> Iterator[tuple]:
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    n = 0
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text, style = _tidy(_word_text(node)), node.find(f"{_W}pPr/{_W}pStyle")
            if text:
                n += 1
                yield 1, n, f"w_b{n:03d}", "text", style.get(f"{_W}val") if style is not None else None, text, None, None
        elif node.tag == f"{_W}tbl":
            cells = list(_table_cells(node))
            if any(t for _, _, t in cells):
                n += 1
                for r, c, text in cells:
                    yield 1, n, f"w_b{n:03d}", "table", None, text, r, c


def _relations(archive: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, kind, target part) of a part's relations."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in archive.namelist():
        return []
    return [(r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target", "")))) for r in ET.fromstring(archive.read(path))]


def _shape_text(shape) -> str:
    return _tidy("\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")))


def _slide_shapes(tree) -> Iterator[tuple[str, object]]:
    """(kind, node) of text shapes and table frames in the order of the slide, groups opened in place."""
    for node in tree:
        if node.tag == f"{_P}grpSp":
            yield from _slide_shapes(node)
        elif node.tag == f"{_P}sp":
            yield "text", node
        elif node.tag == f"{_P}graphicFrame":
            table = node.find(f".//{_A}tbl")
            if table is not None:
                yield "table", table


def _slide_table(table) -> Iterator[tuple[int, int, str]]:
    """Cells of a slide's table: a merged cell's text goes on in all that it covers."""
    above: dict[int, str] = {}
    for r, row in enumerate(table.findall(f"{_A}tr")):
        left = ""
        for c, cell in enumerate(row.findall(f"{_A}tc")):
            text = above.get(c, "") if cell.get("vMerge") in ("1", "true") else left if cell.get("hMerge") in ("1", "true") else _shape_text(cell)
            above[c] = left = text
            yield r, c, text


def ppt_blocks(data: bytes) -> Iterator[tuple]:
    """Text shapes, tables and speaker notes (kind ``notes``) of the slides in the order of the presentation."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)", n)[1]))
    if "ppt/presentation.xml" in names:
        known = {i: target for i, kind, target in _relations(archive, "ppt/presentation.xml") if kind == "slide"}
        listed = [known.get(s.get(f"{_R}id")) for s in ET.fromstring(archive.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        slides = [n for n in listed if n in names] or slides
        numbers = {n: k for k, n in enumerate(slides, 1)}
    else:
        numbers = {n: int(re.search(r"(\d+)", n)[1]) for n in slides}
    for name in slides:
        number, n = numbers[name], 0
        root = ET.fromstring(archive.read(name))
        tree = root.find(f"{_P}cSld/{_P}spTree")
        for kind, node in _slide_shapes(root if tree is None else tree):
            cells = list(_slide_table(node)) if kind == "table" else [(None, None, _shape_text(node))]
            if any(t for _, _, t in cells):
                n += 1
                for r, c, text in cells:
                    yield number, n, f"p{number:03d}_s{n:03d}", kind, None, text, r, c
        for _, kind, target in _relations(archive, name):
            if kind == "notesSlide" and target in names:
                body = [s for s in ET.fromstring(archive.read(target)).iter(f"{_P}sp") if (place := s.find(f".//{_P}ph")) is None or place.get("type") == "body"]
                text = _tidy(" ".join(_shape_text(s) for s in body))
                if text:
                    yield number, n + 1, f"p{number:03d}_notes", "notes", None, text, None, None


def excel_blocks(data: bytes) -> Iterator[tuple]:
    """Full cells, sheets in the workbook's order; the style is the type of the value."""
    number, n = 0, 0
    for _, at, _, row, col, address, value, kind, *_ in sheet_cells(data):
        number, n = at, 1 if at != number else n + 1
        if value.strip():
            yield number, n, address, "cell", kind, value.strip(), row, col


_READERS = {"word": word_blocks, "ppt": ppt_blocks, "excel": excel_blocks}


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all supported files under ``path``, temporary lock files left out; files of the older formats give a row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    chosen = files.where(kind.isin(*TYPES, *OLDER) & ~F.startswith(name, F.lit("~$"))).select(name.alias("doc"), kind.alias("kind"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            for doc, extension, content in batch.itertuples(index=False):
                kind = TYPES.get(extension, extension)
                try:
                    if extension in OLDER:
                        raise ValueError(f".{extension} files are not OOXML: save the file in the newer format")
                    rows = [(doc, kind, *block, None) for block in _READERS[kind](content)]
                except Exception as error:  # any damage of one file stays with that file
                    rows = [(doc, kind, None, None, None, None, None, None, None, None, str(error))]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"container": "Int32", "ord": "Int32", "row": "Int32", "col": "Int32"})

    return chosen.mapInPandas(parse, BLOCK_SCHEMA)
