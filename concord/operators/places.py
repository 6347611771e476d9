"""Places of facts in documents: cell ranges as intervals, ids that exist, facts without a place, units, lines, texts, records as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_number, is_blank

#: Rows of a band of a sheet: a range meets cells band by band.
BAND = 64
SHEET = ["doc", "sheet"]


def range_bounds(cell_range: Column | str) -> Column:
    """(row1, col1, row2, col2) of an A1 range such as ``B2``, ``$B$2:D9`` or a bare row number ``7`` (all its columns); else null."""
    text = F.replace(F.upper(F.trim(F.col(cell_range) if isinstance(cell_range, str) else cell_range)), F.lit("$"), F.lit(""))
    pattern = r"^([A-Z]{1,3})?([0-9]{1,9})(?::([A-Z]{1,3})?([0-9]{1,9}))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    row1, row2 = part(2).cast("int"), F.coalesce(part(4), part(2)).cast("int")
    col1 = F.when(part(1).isNull(), 1).otherwise(column_number(part(1))).cast("int")
    col2 = F.when(part(1).isNull(), 16_384).otherwise(column_number(F.coalesce(part(3), part(1)))).cast("int")
    ordered = F.struct(F.least(row1, row2).alias("row1"), F.least(col1, col2).alias("col1"), F.greatest(row1, row2).alias("row2"), F.greatest(col1, col2).alias("col2"))
    return F.when(text.rlike(pattern) & (part(1).isNull() | part(4).isNull() | part(3).isNotNull()), ordered)


def _ranges(claims: DataFrame, band: int) -> DataFrame:
    """(doc, sheet, fact_id, r, band): each band of rows that the range of a claim touches."""
    ranged = claims.select(*SHEET, "fact_id", range_bounds("cell_range").alias("r")).where("r is not null")
    return ranged.select("*", F.explode(F.sequence(F.floor(F.col("r.row1") / band), F.floor(F.col("r.row2") / band))).alias("band"))


_INSIDE = "row between r.row1 and r.row2 and col between r.col1 and r.col2"


def cited_cells(claims: DataFrame, cells: DataFrame, band: int = BAND) -> DataFrame:
    """(doc, sheet, fact_id, row, col): the cells (doc, sheet, row, col) in the range that each claim (doc, sheet, fact_id, cell_range) names.

    An interval join: ranges and cells meet in bands of ``band`` rows of their sheet, so a large sheet is many keys.
    """
    met = cells.select(*SHEET, "row", "col", F.floor(F.col("row") / band).alias("band")).join(_ranges(claims, band), [*SHEET, "band"])
    return met.where(_INSIDE).select(*SHEET, "fact_id", "row", "col").distinct()


def cell_coverage(cells: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc, sheet, n_cells, n_cited, n_uncited_rows) of every sheet, by ``cited_cells``."""
    marked = cells.select(*SHEET, "row", "col").join(cited.select(*SHEET, "row", "col", F.lit(True).alias("cited")).distinct(), [*SHEET, "row", "col"], "left")
    rows = marked.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n"), F.count("cited").alias("c"))
    return rows.groupBy(*SHEET).agg(F.sum("n").alias("n_cells"), F.sum("c").alias("n_cited"), F.count_if(F.col("c") == 0).alias("n_uncited_rows"))


def sheet_coverage(claims: DataFrame, cells: DataFrame, band: int = BAND) -> DataFrame:
    """``cell_coverage`` of the distinct cells (doc, sheet, row, col) by the ranges of claims (doc, sheet, fact_id, cell_range).

    Cells and ranges are dealt once, by bands; repeated cells, what is cited and the rows of a sheet are told where a band stands, so
    no pair of cell and claim travels.
    """
    dealt = cells.select(*SHEET, "row", "col", F.floor(F.col("row") / band).alias("band")).repartition(*SHEET, "band")
    own, ranges = dealt.groupBy(*SHEET, "band", "row", "col").agg(F.count(F.lit(1)).alias("_n")).drop("_n"), _ranges(claims, band).select(*(F.col(c).alias(f"_{c}") for c in [*SHEET, "band"]), "r")
    met = own.join(ranges, [F.col(c) == F.col(f"_{c}") for c in [*SHEET, "band"]] + [F.expr(_INSIDE)], "left")
    marked = met.groupBy(*SHEET, "band", "row", "col").agg(F.max(F.col("r").isNotNull()).alias("cited"))
    rows = marked.groupBy(*SHEET, "band", "row").agg(F.count(F.lit(1)).alias("n"), F.count_if("cited").alias("c"))
    return rows.groupBy(*SHEET).agg(F.sum("n").alias("n_cells"), F.sum("c").alias("n_cited"), F.count_if(F.col("c") == 0).alias("n_uncited_rows"))


def rebuild_sources(claims: DataFrame, key: list[str], ids: str, locators: DataFrame) -> DataFrame:
    """Claims with their ids (array) cut to those that the document (doc) has (doc, id), in their order and as often; ``lost`` has the
    others, distinct; ``orphan`` marks claims of which no id is left."""
    asked = claims.select("doc", *key, F.posexplode_outer(ids).alias("at", "id"))
    known = locators.select("doc", "id", F.lit(True).alias("known")).distinct()
    found = asked.join(known, ["doc", "id"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("at", "id")))), lambda x: x["id"])
    lost = F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("id"))))
    per = found.groupBy("doc", *key).agg(ordered.alias(ids), lost.alias("lost"))
    return claims.drop(ids).join(per, ["doc", *key]).withColumn("orphan", F.size(ids) == 0)


def facts_without_block(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, fact_id): facts (doc, fact_id, block_ids) that no block of their document holds: none is named, or none exists."""
    return rebuild_sources(facts, ["fact_id"], "block_ids", blocks.select("doc", F.col("block_id").alias("id"))).where("orphan").select("doc", "fact_id")


def units(blocks: DataFrame) -> DataFrame:
    """(doc, unit, blocks): what is read at once: a block of a text document alone, all shapes of a slide together (``doc_type``,
    ``container`` is the slide), in their order."""
    key = F.when(F.col("doc_type") == "ppt", F.struct(F.col("container").alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.col("container").alias("a"), F.col("ord").alias("b")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("container", "ord", "block_id"))), lambda x: x["block_id"])
    return blocks.groupBy("doc", key.alias("unit")).agg(F.array_distinct(ordered).alias("blocks"))


def line_index(blocks: DataFrame, text: str, indent: str | None = None) -> DataFrame:
    """(doc, block_id, line_id, ord, raw_text, indent): the lines of blocks that have more than one, or an indent.

    Lines are stripped, blank ones left out; ids count through a block as ``<block>:l01``; the indent of a line is the white space
    before it, beside that of its block.
    """
    raw = F.posexplode(F.split(text, r"\r?\n"))
    own = F.lit(0) if indent is None else F.coalesce(indent, F.lit(0))
    lines = blocks.select("doc", "block_id", own.alias("_own"), raw.alias("_at", "_raw"))
    kept = lines.where(~is_blank("_raw")).select("doc", "block_id", "_own", F.struct("_at", "_raw").alias("line"))
    grouped = kept.groupBy("doc", "block_id", "_own").agg(F.array_sort(F.collect_list("line")).alias("lines")).where((F.size("lines") > 1) | (F.col("_own") > 0))
    out = grouped.select("doc", "block_id", "_own", F.posexplode("lines").alias("k", "l"))
    return out.select(
        "doc", "block_id", F.format_string("%s:l%02d", F.col("block_id").cast("string"), F.col("k") + 1).alias("line_id"), (F.col("k") + 1).alias("ord"), F.trim(F.regexp_replace("l._raw", r"^\s+|\s+$", "")).alias("raw_text"),
        (F.col("_own") + F.length(F.regexp_extract("l._raw", r"^(\s*)", 1))).cast("int").alias("indent"),
    )


def compact_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, doc_type, json): each document's blocks (doc, doc_type, container, ord, block_id, kind, style, name, text, rows) as JSON in
    their order, without what is null, empty or only says where a shape stands."""
    some = lambda c: F.when(~is_blank(c), F.col(c))
    item = F.struct(F.col("block_id").alias("id"), F.col("kind").alias("type"), F.when(F.col("kind") == "table", None).otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == "table", F.col("rows")).alias("rows"), some("name").alias("name"), some("style").alias("style"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("container", "ord", "block_id", item.alias("item")))), lambda x: x["item"])
    per = blocks.groupBy("doc", "doc_type").agg(ordered.alias("blocks"))
    return per.select("doc", "doc_type", F.to_json(F.struct("doc_type", F.col("doc").alias("file_name"), "blocks")).alias("json"))


def all_texts(blocks: DataFrame) -> DataFrame:
    """(doc, text): the non-blank texts of a document's blocks in their order, one a line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(~is_blank("text"), F.struct("container", "ord", "text")))), lambda x: x["text"])
    return blocks.groupBy("doc").agg(F.array_join(ordered, "\n").alias("text"))


def column_metadata(cells: Column, names: Column) -> Column:
    """The named columns that the row (a map of column to value) has, with the row's own values; other names are left out."""
    wanted = F.transform(names, lambda n: F.trim(n))
    return F.map_filter(cells, lambda k, _: F.array_contains(wanted, k))


def records_to_facts(records: DataFrame) -> DataFrame:
    """Facts of records (doc, sheet, row, record_id, record_type, name, path, attributes, cell_range, evidence_text, metadata) without
    a model: every field passes through, the id is ``fact-`` and the record's, a blank name becomes the last part of the path."""
    name = F.when(~is_blank("name"), F.trim("name")).otherwise(F.coalesce(F.element_at(F.filter("path", lambda p: ~is_blank(p)), -1), F.lit("")))
    return records.where("record_id is not null").select(
        "doc", F.concat(F.lit("fact-"), F.col("record_id").cast("string")).alias("fact_id"), F.coalesce("record_type", F.lit("")).alias("fact_type"), name.alias("entity_name"), "path", "attributes",
        F.struct("sheet", "row", "cell_range").alias("source"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), "metadata",
    )
