"""Sheet semantics over tables turned into cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import guess_role
from ..operators import facts as V
from ..operators import grid as G
from ._tables import Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: A sheet per nation: rows are customers, columns key, name, balance, segment; some rows are banners or have gaps.
_CELLS_SQL = """
    rows_ as (select c_nationkey as doc, 's' as sheet, c_custkey as row, c_custkey::varchar as a, c_name as b, (floor(c_acctbal)::bigint)::varchar as c, case when c_custkey % 3 = 0 then '' else c_mktsegment end as d from customer),
    banner as (select doc, sheet, row, case when row % 17 = 0 then 'Customers' else a end as a, case when row % 17 = 0 then 'Customers' else b end as b, case when row % 17 = 0 then 'Customers' when row % 5 = 0 then '' else c end as c, case when row % 17 = 0 then 'Customers' else d end as d from rows_),
    cells as (select doc, sheet, row, 1 as col, a as value from banner union all select doc, sheet, row, 2, b from banner union all select doc, sheet, row, 3, c from banner union all select doc, sheet, row, 4, d from banner)"""


def sheet_cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    banner = F.col("c_custkey") % 17 == 0
    values = [
        F.col("c_custkey").cast("string"),
        F.col("c_name"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.floor("c_acctbal").cast("string")),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")),
    ]
    cells = F.array(*(F.when(banner, "Customers").otherwise(v) for v in values))
    rows = c.select(F.col("c_nationkey").alias("doc"), F.lit("s").alias("sheet"), F.col("c_custkey").alias("row"), F.posexplode(cells).alias("col", "value"))
    return rows.withColumn("col", F.col("col") + 1)


_SIGNALS = """
    sig as (select doc, sheet, row, count(*) as n_cells, count(*) filter (where trim(value) <> '') as n_full, count(*) filter (where trim(value) <> '' and try_cast(replace(trim(value), ',', '') as double) is not null) as n_numeric, count(distinct case when trim(value) <> '' then trim(value) end) as n_distinct from cells group by doc, sheet, row),
    signals as (select *, case when n_full = 0 then 'blank' when n_cells >= 2 and n_full = n_cells and n_distinct = 1 then 'banner' when n_numeric >= greatest(1, n_full // 2) then 'numeric' when n_distinct > 1 then 'header' else 'text' end as signal from sig)"""


@add(f"with {_CELLS_SQL}, {_SIGNALS} select doc, row, n_full, n_numeric, n_distinct, signal from signals")
def row_signals(spark, sf_dir):
    return G.row_signals(sheet_cells(spark, sf_dir)).select("doc", "row", "n_full", "n_numeric", "n_distinct", "signal")


@add(f"with {_CELLS_SQL}, {_SIGNALS} select doc, min(row) as first_row from signals where signal <> 'banner' group by doc")
def banner_skip(spark, sf_dir):
    return G.first_row_after_banners(G.row_signals(sheet_cells(spark, sf_dir))).select("doc", "first_row")


@add(f"with {_CELLS_SQL} select doc, row, col, last_value(nullif(value, '') ignore nulls) over (partition by doc, sheet, row order by col rows between unbounded preceding and current row) as filled from cells")
def header_ffill(spark, sf_dir):
    return G.fill_right(sheet_cells(spark, sf_dir)).select("doc", "row", "col", "filled")


@add(f"""with {_CELLS_SQL}, top as (select *, dense_rank() over (partition by doc order by row) as r from cells qualify r <= 2),
    f as (select doc, row, col, last_value(nullif(value, '') ignore nulls) over (partition by doc, row order by col rows between unbounded preceding and current row) as v from top),
    u as (select *, lag(v) over (partition by doc, col order by row) as up from f where v is not null)
    select doc, col, string_agg(v, ' > ' order by row) as header from u where up is null or up <> v group by doc, col""")
def header_combine(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("row"))
    top = sheet_cells(spark, sf_dir).withColumn("_r", rank).where("_r <= 2").drop("_r")
    return G.combine_headers(top).select("doc", "col", "header")


@add(f"""with {_CELLS_SQL}, s as (select doc, col, avg(case when try_cast(value as double) is null then 1.0 else 0.0 end) as share from cells where trim(value) <> '' group by 1, 2)
    select c.doc, coalesce(min(s.col), min(c.col)) as key_col from (select distinct doc, col from cells) c left join s on s.doc = c.doc and s.col = c.col and share > 0.5 group by c.doc""")
def key_infer(spark, sf_dir):
    return G.infer_key_column(sheet_cells(spark, sf_dir)).select("doc", "key_col")


@add(f"""with {_CELLS_SQL} select doc, row, string_agg(col || ':' || value, ',' order by col) as cells from cells where trim(value) <> '' group by doc, row""")
def row_map_compact(spark, sf_dir):
    rows = G.compact_rows(sheet_cells(spark, sf_dir))
    text = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ",")
    return rows.select("doc", "row", text.alias("cells"))


@add("select c_custkey as row_id, 'name=' || trim(c_name) || case when c_custkey % 3 = 0 then '' else ' | segment=' || trim(c_mktsegment) end || ' | nation=' || c_nationkey as text from customer")
def record_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("row_id"), G.record_text(["name", "segment", "nation"], [F.col("c_name"), segment, F.col("c_nationkey").cast("string")]).alias("text"))


@add("""select row_id, row_id || '#f' || n as field_id, header, value from (
    select c_custkey as row_id, 1 as n, 'c_name' as header, c_name as value from customer union all select c_custkey, 2, 'c_nationkey', c_nationkey::varchar from customer union all select c_custkey, 3, 'c_mktsegment', c_mktsegment from customer) where trim(value) <> ''""")
def field_explode(spark, sf_dir):
    return G.explode_fields(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@add(f"""with {_CELLS_SQL}, reg as (select doc, sheet, row as top, 2 as l, row as bottom, 4 as r from banner where row % 3 = 0)
    select c.doc, c.row, c.col, case when trim(coalesce(c.value, '')) = '' and reg.top is not null then (select a.value from cells a where a.doc = reg.doc and a.row = reg.top and a.col = reg.l) else c.value end as value
    from cells c left join reg on c.doc = reg.doc and c.row between reg.top and reg.bottom and c.col between reg.l and reg.r""")
def merged_fill(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    regions = cells.where("row % 3 = 0 and col = 1").select("doc", "sheet", F.col("row").alias("top"), F.lit(2).alias("left"), F.col("row").alias("bottom"), F.lit(4).alias("right"))
    return G.fill_merged(cells, regions).select("doc", "row", "col", "value")


_HEADERS = """h as (select p_partkey as id, case p_partkey % 7 when 0 then 'Item ' || p_size when 1 then 'max. current' when 2 then 'Nominal value' when 3 then 'UNIT' when 4 then p_type when 5 then 'lower limit (min)' else '하 한치' end as header from part)"""
_ROLE = """case when header = '' then null when regexp_matches(lower(header), '\\b(?:min|lower|lsl)\\b') or contains(replace(header, ' ', ''), '하한') then 'quantitative_lower_bound' when regexp_matches(lower(header), '\\b(?:max|upper|usl)\\b') then 'quantitative_upper_bound' when regexp_matches(lower(header), '\\b(?:target|nominal|typ|center)\\b') then 'quantitative_target'
    when regexp_matches(lower(header), '\\b(?:unit|uom)\\b') then 'unit' when regexp_matches(lower(header), '\\b(?:subcategory|subcat)\\b') then 'entity_subcategory' when regexp_matches(lower(header), '\\bcategory\\b') then 'entity_category' when regexp_matches(lower(header), '\\b(?:name|item|parameter|param)\\b') then 'entity_name'
    when regexp_matches(lower(header), '\\b(?:remark|note|description)\\b') then 'qualitative_spec' when regexp_matches(lower(header), '\\b(?:version|date|author|no)\\b') then 'metadata' end"""


def _headers(spark, sf_dir):
    k = F.col("p_partkey") % 7
    header = F.when(k == 0, F.concat(F.lit("Item "), F.col("p_size").cast("string"))).when(k == 1, "max. current").when(k == 2, "Nominal value").when(k == 3, "UNIT").when(k == 4, F.col("p_type")).when(k == 5, "lower limit (min)").otherwise("하 한치")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), header.alias("header"))


@add(f"with {_HEADERS} select id, {_ROLE} as role from h")
def guess_roles(spark, sf_dir):
    return _headers(spark, sf_dir).select("id", guess_role("header").alias("role"))


@add(f"""with {_HEADERS}, r as (select id // 10 as doc, id, {_ROLE} as role from h)
    select doc, role, count(*) as n, string_agg(id::varchar, ',' order by id::varchar) as columns from r where role in ('quantitative_lower_bound', 'quantitative_upper_bound', 'quantitative_target', 'unit') group by 1, 2 having count(*) > 1""")
def role_duplicates(spark, sf_dir):
    columns = _headers(spark, sf_dir).select(F.floor(F.col("id") / 10).cast("long").alias("doc"), F.col("id").cast("string").alias("column"), guess_role("header").alias("role"))
    return V.duplicate_roles(columns, ("quantitative_lower_bound", "quantitative_upper_bound", "quantitative_target", "unit"))
