"""Sheet semantics on long-form cells (doc, sheet, row, col, value), and records made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_numeric
from ..functions.text import collapse, column_letters, is_blank

SHEET = ("doc", "sheet")


def row_signals(cells: DataFrame) -> DataFrame:
    """Per row: counts and its class blank, banner, numeric, header or text."""
    value = F.trim(F.coalesce("value", F.lit("")))
    full = value != ""
    rows = cells.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(full).alias("n_full"),
        F.count_if(full & is_numeric(value)).alias("n_numeric"),
        F.count_distinct(F.when(full, value)).alias("n_distinct"),
    )
    banner = (F.col("n_cells") >= 2) & (F.col("n_full") == F.col("n_cells")) & (F.col("n_distinct") == 1)
    signal = (
        F.when(F.col("n_full") == 0, "blank").when(banner, "banner")
        .when(F.col("n_numeric") >= F.greatest(F.lit(1), F.floor(F.col("n_full") / 2)), "numeric")
        .when(F.col("n_distinct") > 1, "header").otherwise("text")
    )
    return rows.withColumn("signal", signal)


def first_row_after_banners(signals: DataFrame) -> DataFrame:
    """(doc, sheet, first_row): the first row that is no banner."""
    return signals.where("signal <> 'banner'").groupBy(*SHEET).agg(F.min("row").alias("first_row"))


def fill_right(cells: DataFrame) -> DataFrame:
    """Empty cells take the nearest value to their left."""
    window = Window.partitionBy(*SHEET, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.when(~is_blank("value"), F.col("value")), ignorenulls=True).over(window))


def combine_headers(header_cells: DataFrame, sep: str = " > ") -> DataFrame:
    """(doc, sheet, col, header): labels of header rows from the top, equal neighbours once; with several header rows, each
    is filled to the right first."""
    rows = header_cells.groupBy(*SHEET).agg(F.count_distinct("row").alias("_rows"))
    own = F.when(~is_blank("value"), F.col("value"))
    filled = fill_right(header_cells).join(rows, list(SHEET)).withColumn("filled", F.when(F.col("_rows") > 1, F.col("filled")).otherwise(own)).drop("_rows").where("filled is not null")
    upper = F.lag("filled").over(Window.partitionBy(*SHEET, "col").orderBy("row"))
    fresh = filled.withColumn("_upper", upper).where(F.col("_upper").isNull() | (F.col("_upper") != F.col("filled")))
    return fresh.groupBy(*SHEET, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "filled"))), lambda s: s["filled"]), sep).alias("header"))


def infer_key_column(cells: DataFrame, skip: tuple[int, ...] = ()) -> DataFrame:
    """(doc, sheet, key_col): the first column of which more than half the full cells are no numbers, or else the first."""
    usable = cells.where(~F.col("col").isin(*skip)) if skip else cells
    share = usable.where(~is_blank("value")).groupBy(*SHEET, "col").agg(F.avg(F.when(is_numeric("value"), 0.0).otherwise(1.0)).alias("text_share"))
    firsts = usable.groupBy(*SHEET).agg(F.min("col").alias("_first"))
    keys = share.where("text_share > 0.5").groupBy(*SHEET).agg(F.min("col").alias("_key"))
    return firsts.join(keys, list(SHEET), "left").select(*SHEET, F.coalesce("_key", "_first").alias("key_col"))


def record_text(names: list[str], values: list[Column]) -> Column:
    """``header=value`` pairs of non-empty values, joined by `` | ``."""
    pairs = [F.when(~is_blank(v), F.concat(F.lit(f"{n}="), collapse(v))) for n, v in zip(names, values, strict=True)]
    return F.concat_ws(" | ", *pairs)


def explode_fields(rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """One row per non-empty compared cell: (row_id, field_id, header, value)."""
    fields = F.array(*(F.struct(F.lit(c).alias("header"), F.col(c).cast("string").alias("value"), F.lit(k + 1).alias("n")) for k, c in enumerate(columns)))
    out = rows.select(F.col(row_id).alias("row_id"), F.explode(fields).alias("f")).where(~is_blank("f.value"))
    return out.select("row_id", F.concat(F.col("row_id").cast("string"), F.lit("#f"), F.col("f.n").cast("string")).alias("field_id"), "f.header", "f.value")


def compact_rows(cells: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(doc, sheet, row, cells): each row's full cells as a map by column, in column order."""
    kept = cells.where(~is_blank("value"))
    rows = kept.groupBy(*SHEET, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col").alias("key"), "value")))).alias("cells"))
    if max_rows is None:
        return rows
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    return rows.withColumn("_n", number).where(F.col("_n") <= max_rows).drop("_n")


def fill_merged(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Empty cells of a merged region (doc, sheet, top, left, bottom, right) take the value of its first cell."""
    spans = regions.select(*SHEET, "top", "left", F.explode(F.sequence("top", "bottom")).alias("row"), "right").select(*SHEET, "top", "left", "row", F.explode(F.sequence("left", "right")).alias("col"))
    anchors = cells.select(*SHEET, F.col("row").alias("top"), F.col("col").alias("left"), F.col("value").alias("_anchor"))
    merged = spans.join(anchors, [*SHEET, "top", "left"]).select(*SHEET, "row", "col", "_anchor")
    joined = cells.join(merged, [*SHEET, "row", "col"], "full")
    return joined.withColumn("value", F.when(is_blank("value"), F.coalesce("_anchor", "value")).otherwise(F.col("value"))).drop("_anchor")


def primary_sheet(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc, sheet): the first sheet (pos, hidden) of each document that is not hidden and has a full cell."""
    full = cells.where(~is_blank("value")).select(*SHEET).distinct()
    return sheets.where("not hidden").join(full, list(SHEET), "left_semi").groupBy("doc").agg(F.min_by("sheet", "pos").alias("sheet"))


def data_rows(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """Cells from the first data row on: as a sheet's profile (data_start, header_start, header_rows) says, or else row 1."""
    start = F.coalesce("data_start", F.col("header_start") + F.col("header_rows"), F.lit(1))
    return cells.join(profile.select(*SHEET, start.alias("_start")), list(SHEET)).where(F.col("row") >= F.col("_start")).drop("_start")


def cell_ranges(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc, sheet, row, cell_range): from the first to the last full cell of each row among the mapped columns (sheet keys, col)."""
    mapped = cells.where(~is_blank("value")).join(columns.select(*SHEET, "col").distinct(), [*SHEET, "col"], "left_semi")
    ends = mapped.groupBy(*SHEET, "row").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    at = lambda c: F.concat(column_letters(c), F.col("row").cast("string"))
    return ends.select(*SHEET, "row", F.when(F.col("a") == F.col("b"), at("a")).otherwise(F.concat(at("a"), F.lit(":"), at("b"))).alias("cell_range"))


def resolve_columns(headers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, sheet, ask, col) of asked columns (doc, sheet, ask): a name without regard to case and white space at its ends (the
    first such header), or a number from 1 that the sheet has."""
    named = headers.groupBy(*SHEET, F.lower(F.trim("header")).alias("_name")).agg(F.min("col").alias("_named"))
    width = headers.groupBy(*SHEET).agg(F.max("col").alias("_width"))
    asked = wanted.withColumn("_name", F.lower(F.trim("ask"))).withColumn("_number", F.when(F.trim("ask").rlike("^[0-9]{1,6}$"), F.trim("ask").cast("int")))
    found = asked.join(named, [*SHEET, "_name"], "left").join(width, list(SHEET))
    col = F.coalesce("_named", F.when(F.col("_number").between(1, F.col("_width")), F.col("_number")))
    return found.where(col.isNotNull()).select(*SHEET, "ask", col.alias("col"))


def overlay_display(cells: DataFrame, shown: DataFrame) -> DataFrame:
    """Cells with the text that the sheet shows (sheet keys, row, col, display) in place of the value, an empty one too."""
    return cells.join(shown.select(*SHEET, "row", "col", "display", F.lit(True).alias("_shown")), [*SHEET, "row", "col"], "left").withColumn("value", F.when(F.col("_shown"), F.col("display")).otherwise(F.col("value"))).drop("display", "_shown")


def sheet_summary(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """Per sheet: full cells, the used range (null without one), and how many number formats other than General there are.
    ``formats`` is (sheet keys, row, col, number_format)."""
    full = ~is_blank("value")
    own = F.when(F.lower(F.trim("number_format")) != "general", F.col("number_format"))
    rows = cells.join(formats.select(*SHEET, "row", "col", own.alias("_format")), [*SHEET, "row", "col"], "left")
    used = lambda f, c: f(F.when(full, F.col(c)))
    per = rows.groupBy(*SHEET).agg(F.count_if(full).alias("n_cells"), used(F.min, "row").alias("a"), used(F.min, "col").alias("b"), used(F.max, "row").alias("c"), used(F.max, "col").alias("d"), F.count_distinct(F.when(full, F.col("_format"))).alias("n_formats"))
    corner = lambda col, row: F.concat(column_letters(col), F.col(row).cast("string"))
    return per.select(*SHEET, "n_cells", F.when(F.col("n_cells") > 0, F.concat(corner("b", "a"), F.lit(":"), corner("d", "c"))).alias("used_range"), "n_formats")


def choose_header(signals: DataFrame, header_row: int = 1, skip_banners: bool = True) -> DataFrame:
    """(doc, sheet, header_start): the row ``header_row`` of each sheet, or the first after it that is no banner; null if the sheet ends
    before it or begins after it."""
    ends = signals.groupBy(*SHEET).agg(F.min("row").alias("_first"), F.max("row").alias("_last"), F.min(F.when((F.col("row") >= header_row) & (F.col("signal") != "banner"), F.col("row"))).alias("_next"))
    inside = (F.col("_first") <= header_row) & (F.col("_last") >= header_row)
    return ends.select(*SHEET, F.when(inside, F.col("_next") if skip_banners else F.lit(header_row)).alias("header_start"))


def build_records(cells: DataFrame, headers: DataFrame, keys: DataFrame) -> DataFrame:
    """One record per row that has a full cell: (sheet keys, row, item_id, key_context, text, label, fields).

    ``headers`` is (sheet keys, col, header), ``keys`` the key columns (sheet keys, col).  The text joins ``header=value`` of all full
    cells, the key context those of key columns; fields are the other cells with header, value and place; a column without a
    header is ``col`` and its number.
    """
    marked = cells.where(~is_blank("value")).join(headers.select(*SHEET, "col", "header"), [*SHEET, "col"], "left").join(keys.select(*SHEET, "col", F.lit(True).alias("_key")).distinct(), [*SHEET, "col"], "left")
    name = F.when(is_blank("header"), F.concat(F.lit("col"), F.col("col").cast("string"))).otherwise(F.col("header"))
    cell = F.struct("col", name.alias("header"), F.trim("value").alias("value"), F.coalesce("_key", F.lit(False)).alias("is_key"))
    rows = marked.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    pair = lambda c: F.concat(c["header"], F.lit("="), c["value"])
    key = F.array_join(F.transform(F.filter("_cells", lambda c: c["is_key"]), pair), ", ")
    context = F.when(key == "", "").otherwise(F.concat(F.lit("["), key, F.lit("]")))
    at = F.concat("doc", F.lit("#"), "sheet", F.lit("!"))
    label = F.concat("doc", F.lit(" > ["), "sheet", F.lit("] "), F.col("row").cast("string"), F.when(context == "", "").otherwise(F.concat(F.lit(" "), context)))
    fields = F.transform(F.filter("_cells", lambda c: ~c["is_key"]), lambda c: F.struct(F.concat(at, column_letters(c["col"]), F.col("row").cast("string")).alias("field_id"), c["header"].alias("header"), c["value"].alias("value")))
    return rows.select(*SHEET, "row", F.concat(at, F.col("row").cast("string")).alias("item_id"), context.alias("key_context"), F.array_join(F.transform("_cells", pair), " | ").alias("text"), label.alias("label"), fields.alias("fields"))


def split_records(records: DataFrame) -> DataFrame:
    """One item per field of a record: (item_id, key_context, text, label) with the key context before the text."""
    each = records.select("*", F.explode("fields").alias("f"))
    return each.select("doc", F.col("f.field_id").alias("item_id"), "key_context", F.concat_ws(" ", F.when(F.col("key_context") != "", F.col("key_context")), F.concat("f.header", F.lit("="), "f.value")).alias("text"), F.concat("label", F.lit(" · "), "f.header").alias("label"))


def compare_columns(headers: DataFrame, keys: DataFrame, skipped: DataFrame) -> DataFrame:
    """The columns of each sheet that are neither key nor skipped."""
    out = headers.select(*SHEET, "col").distinct()
    for other in (keys, skipped):
        out = out.join(other.select(*SHEET, "col").distinct(), [*SHEET, "col"], "left_anti")
    return out
