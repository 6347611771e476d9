"""Records of sheets and small labels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import grid as G
from ..sources import artifacts as A
from ._tables import Registry, table
from .grids import _CELLS_SQL, _SIGNALS, sheet_cells

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

_HEADERS = "h as (select * from (values (1, 'Key'), (2, 'Name'), (3, ''), (4, 'Segment')) v(col, header))"
_RECORDS = f"""{_CELLS_SQL}, {_HEADERS}, c as (select doc, row, col, case when header = '' then 'col' || col else header end as header, trim(value) as value from cells join h using (col) where trim(value) <> ''),
    r as (select doc, row, '[' || string_agg(header || '=' || value, ', ' order by col) filter (where col <= 2) || ']' as ctx, string_agg(header || '=' || value, ' | ' order by col) as text from c group by 1, 2)"""


def _sheet(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir).withColumn("doc", F.col("doc").cast("string"))
    sheets = cells.select("doc", "sheet").distinct()
    headers = sheets.select("*", F.posexplode(F.array(*(F.lit(x) for x in ("Key", "Name", "", "Segment")))).alias("col", "header")).withColumn("col", F.col("col") + 1)
    return cells, headers, headers.where("col <= 2")


@add(f"with {_RECORDS} select doc::varchar || '#s!' || row as item_id, coalesce(ctx, '') as key_context, text, doc::varchar || ' > [s] ' || row || coalesce(' ' || ctx, '') as label from r")
def row_records(spark, sf_dir):
    return G.build_records(*_sheet(spark, sf_dir)).select("item_id", "key_context", "text", "label")


@add(f"with {_RECORDS} select doc::varchar as doc, doc::varchar || '#s!' || chr(64 + col) || row as item_id, ctx as key_context, ctx || ' ' || header || '=' || value as text, doc::varchar || ' > [s] ' || row || ' ' || ctx || ' · ' || header as label from c join r using (doc, row) where col > 2")
def field_records(spark, sf_dir):
    return G.split_records(G.build_records(*_sheet(spark, sf_dir)))


@add(f"with {_CELLS_SQL} select doc, row, col, case when col = 3 and row % 4 = 0 then '' when col = 3 and row % 4 = 1 then 'shown ' || row else value end as value from cells")
def shown_values(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    shown = cells.where("col = 3 and row % 4 < 2").select("doc", "sheet", "row", "col", F.when(F.col("row") % 4 == 0, "").otherwise(F.concat(F.lit("shown "), F.col("row").cast("string"))).alias("display"))
    return G.overlay_display(cells, shown).select("doc", "row", "col", "value")


@add(f"with {_CELLS_SQL} select doc, count(*) filter (where trim(value) <> '') as n_cells, chr(64 + (min(col) filter (where trim(value) <> ''))::int) || min(row) filter (where trim(value) <> '') || ':' || chr(64 + (max(col) filter (where trim(value) <> ''))::int) || max(row) filter (where trim(value) <> '') as used_range, count(distinct case when row % 5 > 0 then '0.' || (row % 5) end) filter (where trim(value) <> '') as n_formats from cells group by 1")
def sheet_summaries(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    k = F.col("row") % 5
    formats = cells.select("doc", "sheet", "row", "col", F.when(k == 0, "General").otherwise(F.concat(F.lit("0."), k.cast("string"))).alias("number_format"))
    return G.sheet_summary(cells, formats).select("doc", "n_cells", "used_range", "n_formats")


@add(f"with {_CELLS_SQL}, {_SIGNALS} select doc, case when min(row) <= 17 and max(row) >= 17 then min(case when row >= 17 and signal <> 'banner' then row end) end as header_start from signals group by 1")
def header_choice(spark, sf_dir):
    return G.choose_header(G.row_signals(sheet_cells(spark, sf_dir)), 17).select("doc", "header_start")


@add(f"with {_CELLS_SQL} select distinct doc, col from cells where col > 2 and not (col = 4 and doc % 2 = 0)")
def compared_columns(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    return G.compare_columns(cells, cells.where("col <= 2"), cells.where("col = 4 and doc % 2 = 0")).select("doc", "col")


@add("select p_partkey, case when p_size % 3 = 0 then '-' when p_size % 3 = 1 then 'size=' || p_size || 'mm' else 'size=' || p_size || 'mm, brand=' || p_brand end as said from part")
def attribute_lines(spark, sf_dir):
    """Attributes given as a list of named items, some without a name and some named twice, in one line."""
    k = F.col("p_size") % 3
    item = lambda name, value, unit: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).alias("unit"))
    items = F.array_compact(F.array(item(" ", F.col("p_name"), ""), F.when(k > 0, item("size", F.lit(0), "")), F.when(k > 0, item(" size", F.col("p_size"), "mm")), F.when(k == 2, item("brand", F.col("p_brand"), ""))))
    return table(spark, sf_dir, "part").select("p_partkey", L.attributes_text(L.named_map(items)).alias("said"))


@add("select p_partkey, case p_size % 5 when 0 then case when p_size % 2 = 0 then p_brand || '!' || p_type else p_brand end when 1 then '블록 ' || p_partkey || ', ' || (p_partkey + 1) when 2 then '슬라이드 ' || p_size || ' / 도형 ' || p_partkey when 3 then '슬라이드 ' || p_size else '-' end as place from part")
def place_lines(spark, sf_dir):
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "excel").when(k == 1, "word").when(k < 4, "ppt").otherwise("other")
    where = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", L.place_text(kind, F.col("p_brand"), where, F.array(F.col("p_partkey"), F.col("p_partkey") + 1), F.col("p_size"), F.when(k == 2, F.array("p_partkey"))).alias("place"))


@add("select p_partkey, 'FF' || lpad(to_hex(p_partkey % 256), 2, '0') || lpad(to_hex((p_partkey * 7) // 256 % 256), 2, '0') || '00' as filled, case p_size % 3 when 0 then true when 1 then false end as bold, p_size || ': ' || p_brand || case when p_size % 2 = 0 then ' <unit>' else '' end as summary from part")
def cell_looks(spark, sf_dir):
    n = F.col("p_partkey")
    colour = n % 256 + F.floor(n * 7 / 256) % 256 * 256
    bold = F.when(F.col("p_size") % 3 == 0, -1).when(F.col("p_size") % 3 == 1, 0).otherwise(9999999)
    role = F.when(F.col("p_size") % 2 == 0, "unit").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", L.argb(colour).alias("filled"), L.tristate(bold).alias("bold"), L.column_summary("p_size", "p_brand", role, F.lit("")).alias("summary"))


@add("select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"' || case when n_nationkey % 2 = 0 then ',\"n_regionkey\":' || n_regionkey else '' end || '}' as json from nation")
def row_payloads(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    return A.payload(n, "n_nationkey")
