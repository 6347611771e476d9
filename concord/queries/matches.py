"""Candidates, findings, scores and statistics of comparisons; texts and cells in detail."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import events as E
from ..operators import facts as V
from ..operators import grid as G
from ..operators import matching as M
from ._tables import NORM, Registry, node, table
from .documents import page_blocks, _BLOCKS
from .grids import _CELLS_SQL, sheet_cells

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

_LINE = "l_orderkey * 10 + l_linenumber"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@add(f"""with t as (select l_returnflag as doc, {_LINE} as fact_id, case when l_partkey % 4 = 0 then 'spare ' || l_partkey else 'PART-' || l_partkey end as name, l_partkey, l_discount, l_suppkey from lineitem),
    first as (select doc, {NORM.format('name')} as n, min(fact_id) as target_id from t group by all),
    exact as (select p_partkey as ref_id, doc as target_doc, target_id, 1.0 as score, 'name' as method, 1 as place, false as needs_review from part join first on n = {NORM.format("'Part ' || p_partkey")}),
    ranked as (select l_partkey as ref_id, doc as target_doc, fact_id as target_id, l_discount as score, row_number() over (partition by l_partkey, doc order by l_discount desc, fact_id, l_suppkey) as rank, l_discount < 0.05 as needs_review from t)
    select * from exact union all select ref_id, target_doc, target_id, score, 'ranked', rank::int, needs_review from ranked r where rank <= 3 and not exists (select 1 from exact e where e.ref_id = r.ref_id and e.target_doc = r.target_doc)""")
def candidates_per_target(spark, sf_dir):
    """Parts against the lines of each return flag: by name, or else by rank."""
    l = _lines(spark, sf_dir)  # noqa: E741
    name = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("spare "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("PART-"), F.col("l_partkey").cast("string")))
    targets = l.select(F.col("l_returnflag").alias("doc"), F.col("line").alias("fact_id"), name.alias("entity_name"), F.col("line").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("l_partkey", "l_returnflag").orderBy(F.desc("l_discount"), "line", "l_suppkey"))
    ranked = l.select(F.col("l_partkey").alias("ref_id"), F.col("l_returnflag").alias("target_doc"), F.col("line").alias("target_id"), F.col("l_discount").alias("score"), rank.alias("rank"), (F.col("l_discount") < 0.05).alias("needs_review"))
    reference = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("entity_name"))
    return M.candidates(reference, targets, ranked)


_EDGES = f"e as (select 'parts' as left_doc, l_partkey as left_id, l_linestatus as right_doc, l_suppkey + 1000000 as right_id, case when l_returnflag = 'R' then 'differs_by' else 'same_as' end as relation, case when l_quantity < 5 then '' else l_returnflag || (l_linenumber % 3) end as axis, l_quantity > 45 as promoted, ({_LINE}) * 100 + l_suppkey as pos from lineitem)"


def _edges(spark, sf_dir):
    l = _lines(spark, sf_dir)  # noqa: E741
    axis = F.when(F.col("l_quantity") < 5, "").otherwise(F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))
    return l.select(F.lit("parts").alias("left_doc"), node(0, F.col("l_partkey")).alias("left_id"), F.col("l_linestatus").alias("right_doc"), node(1, F.col("l_suppkey") + 1_000_000).alias("right_id"), F.when(F.col("l_returnflag") == "R", "differs_by").otherwise("same_as").alias("relation"), axis.alias("axis"), (F.col("l_quantity") > 45).alias("promoted"), (F.col("line") * 100 + F.col("l_suppkey")).alias("pos"))


@add(f"with {_EDGES}, f as (select left_id, right_id, arg_min(relation, pos) as relation from e group by 1, 2), p as (select p_partkey as a, 1000000 + p_partkey % 100 as b from part) select a, b, relation from p left join f on left_id = a and right_id = b")
def edge_lookup(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(node(0, F.col("p_partkey")).alias("a"), node(1, 1_000_000 + F.col("p_partkey") % 100).alias("b"))
    return M.edge_between(pairs, _edges(spark, sf_dir)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "relation")


@add(f"with {_EDGES} select left_id as ref_id, right_doc as target_doc, count(*) as n_blockers, bool_or(promoted) as confirmed, coalesce(array_to_string(list_sort(list_distinct(list(axis) filter (where axis <> ''))), ', '), '') as axes from e where relation = 'differs_by' and left_id in (select p_partkey from part) group by 1, 2")
def blocked_by(spark, sf_dir):
    reference = table(spark, sf_dir, "part").select(node(0, F.col("p_partkey")).alias("fact_id"))
    return M.blocked_by(reference, _edges(spark, sf_dir)).withColumn("ref_id", F.col("ref_id.id"))


_FOUND = """fields as (select c_custkey as row_id, c_custkey || '#f' || n as field_id from customer, (values (1), (2), (3)) v(n)), f as (select o_custkey as row_id, o_custkey || '#f' || (o_orderkey % 4 + 1) as field_id, arg_max(case o_orderstatus when 'F' then 'match' when 'O' then 'different' else 'partial' end, o_orderkey) as result from orders group by 1, 2),
    found as (select row_id, field_id, coalesce(result, 'not_found') as result, result is not null as found from fields left join f using (row_id, field_id))"""


def _found(spark, sf_dir):
    fields = G.explode_fields(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]).select("row_id", "field_id")
    status = F.when(F.col("o_orderstatus") == "F", "match").when(F.col("o_orderstatus") == "O", "different").otherwise("partial")
    field = F.concat(F.col("o_custkey").cast("string"), F.lit("#f"), (F.col("o_orderkey") % 4 + 1).cast("string"))
    findings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), field.alias("field_id"), status.alias("result"), F.col("o_orderkey").alias("pos"))
    return M.record_findings(fields, findings, "row_id", "field_id")


@add(f"with {_FOUND} select * from found")
def record_findings(spark, sf_dir):
    return _found(spark, sf_dir)


@add(f"with {_FOUND} select row_id, case when not bool_or(found) then 'not_found' when bool_and(result = 'match') then 'match' else 'partial' end as result from found group by 1")
def record_results(spark, sf_dir):
    return M.record_result(_found(spark, sf_dir), "row_id")


@add("with r as (select p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as a, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as b, p_size from part), j as (select p_partkey, case when p_size % 5 = 0 then 999 else a end as old_rank, case when p_size % 7 = 0 then 999 else b end as new_rank from r) select p_partkey, old_rank, new_rank, case when old_rank > 10 and new_rank <= 10 then 'enters' when old_rank <= 10 and new_rank > 10 then 'leaves' when new_rank < old_rank then 'better' else 'worse' end as change from j where old_rank <> new_rank")
def rank_changes(spark, sf_dir):
    """Ranks of parts in their brand by size and by price; some are in one list alone."""
    rank = lambda *by: F.row_number().over(Window.partitionBy("p_brand").orderBy(*by))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", rank("p_size", "p_partkey").alias("a"), rank(F.desc("p_retailprice"), "p_partkey").alias("b"))
    return M.rank_changes(p.where("p_size % 5 <> 0").select("p_partkey", F.col("a").alias("rank")), p.where("p_size % 7 <> 0").select("p_partkey", F.col("b").alias("rank")), "p_partkey", 10)


@add("""with o as (select l_orderkey, list_sort(list_distinct(list(l_linenumber))) as c, list_sort(list_distinct(list(case when l_returnflag = 'N' then l_linenumber + 5 else l_linenumber end) filter (where l_returnflag <> 'R'))) as f from lineitem group by 1),
    s as (select l_orderkey, c, list_filter(c, lambda x: not list_contains(coalesce(f, []), x)) as lost, len(list_filter(coalesce(f, []), lambda x: not list_contains(c, x))) as unknown from o)
    select l_orderkey, array_to_string(lost, ',') as lost, unknown from s where len(c) >= 2 and (len(lost) > 0 or unknown > 0)""")
def finding_shortfall(spark, sf_dir):
    """Lines of an order as candidates, and as findings those that were not returned, some under another number."""
    shown = F.when(F.col("l_returnflag") == "N", F.col("l_linenumber") + 5).otherwise(F.col("l_linenumber"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("candidate_ids"), F.collect_set(F.when(F.col("l_returnflag") != "R", shown)).alias("finding_ids"))
    return M.shortfall(o).select("l_orderkey", F.array_join("lost", ",").alias("lost"), F.col("unknown").cast("long").alias("unknown"))


@add("""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from documents), s as (select doc_id, k, regexp_replace(x, '^[\\t\\r ]+|[\\t\\r ]+$', '', 'g') as t, length(replace(regexp_extract(x, '^[ \\t]*'), chr(9), '    ')) as indent from l)
    select doc_id, row_number() over (partition by doc_id order by k) as line, md5(t) as digest, indent from s where t <> ''""")
def line_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.lines_of("text")).alias("l"))
    return d.select("doc_id", "l.line", F.md5(F.col("l.text").cast("binary")).alias("digest"), "l.indent")


@add("select p_partkey as id, case when p_size % 3 = 0 then p_size end as level from part")
def heading_levels(spark, sf_dir):
    style = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Heading "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, "Heading").otherwise(F.concat(F.lit("My heading "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.heading_level(style).alias("level"))


def _profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc")).agg(F.min("c_custkey").alias("least"))
    return c.select("doc", F.lit("s").alias("sheet"), F.when(F.col("doc") % 3 == 0, F.col("least") + 40).alias("data_start"), F.when(F.col("doc") % 3 == 1, F.col("least")).alias("header_start"), F.lit(2).alias("header_rows"))


@add(f"with {_CELLS_SQL}, p as (select c_nationkey as doc, case when c_nationkey % 3 = 0 then min(c_custkey) + 40 when c_nationkey % 3 = 1 then min(c_custkey) + 2 else 1 end as start from customer group by 1) select c.doc, row, col from cells c join p on p.doc = c.doc and row >= start")
def data_rows(spark, sf_dir):
    return G.data_rows(sheet_cells(spark, sf_dir), _profile(spark, sf_dir)).select("doc", "row", "col")


@add(f"with {_CELLS_SQL}, e as (select doc, row, min(col) as a, max(col) as b from cells where trim(value) <> '' and col in (2, 3, 4) group by 1, 2) select doc, row, case when a = b then chr(64 + a) || row else chr(64 + a) || row || ':' || chr(64 + b) || row end as cell_range from e")
def cell_ranges(spark, sf_dir):
    cells = sheet_cells(spark, sf_dir)
    return G.cell_ranges(cells, cells.where("col > 1").select("doc", "sheet", "col").distinct()).select("doc", "row", "cell_range")


@add("select n_nationkey as doc, ask, col from nation, (values (' NAME ', 2), ('segment', 4), ('1', 1), ('key', 1)) v(ask, col)")
def resolve_columns(spark, sf_dir):
    sheets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.lit("s").alias("sheet"))
    headers = sheets.select("*", F.posexplode(F.array(*(F.lit(h) for h in ("Key", "Name", "Balance", "Segment", "name")))).alias("col", "header")).withColumn("col", F.col("col") + 1)
    wanted = sheets.select("*", F.explode(F.array(*(F.lit(a) for a in (" NAME ", "segment", "1", "key", "9", "none")))).alias("ask"))
    return G.resolve_columns(headers, wanted).select("doc", "ask", "col")


@add("with s as (select c_nationkey as doc, c_mktsegment as sheet, min(c_custkey) as pos, count(*) % 2 = 0 as hidden from customer group by 1, 2) select doc, arg_min(sheet, pos) as sheet from s where not hidden group by 1")
def primary_sheets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("sheet"), "c_custkey", F.col("c_name").alias("value"))
    sheets = c.groupBy("doc", "sheet").agg(F.min("c_custkey").alias("pos"), (F.count(F.lit(1)) % 2 == 0).alias("hidden"))
    return G.primary_sheet(c, sheets)


@add("with r as (select c_nationkey as doc, case when c_acctbal < 0 then 'debt' when c_custkey % 9 = 0 then 'ninth' else '' end as why, c_name from customer) select doc, count(*) as seen, count(*) filter (where why = '') as kept, count(*) filter (where why <> '') as dropped, coalesce(array_to_string(list_sort(list_distinct(list(why || ': ' || c_name) filter (where why <> '')))[1:5], '; '), '') as samples from r group by 1")
def extraction_stats(spark, sf_dir):
    why = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_custkey") % 9 == 0, "ninth").otherwise("")
    return V.extraction_stats(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), why.alias("drop_reason"), F.col("c_name").alias("sample")), "doc")


@add(f"with {_BLOCKS} select doc, count(*) as blocks_in, count(*) filter (where length(block_text) > 60) as blocks_cited, round(avg(case when length(block_text) > 60 then 1.0 else 0.0 end), 6) as share from blocks group by 1")
def coverage_summary(spark, sf_dir):
    blocks = page_blocks(spark, sf_dir)
    cited = blocks.where("length(block_text) > 60").select("doc", "block_id", F.lit(1).alias("fact_id"))
    return V.coverage_summary(V.facts_by_block(blocks, cited), "doc")


@add("select o_custkey, case when lower(o_orderstatus) = 'f' then 'f' else 'other' end as result, o_custkey::varchar as left_end, o_orderkey::varchar as right_end, case when o_totalprice > 200000 then o_orderpriority else o_orderstatus end as said, contains(o_orderpriority, 'URGENT') as quoted, 'date' as t1, 'number' as t2, 'text' as t3 from orders")
def small_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pair = X.split_pair(F.concat_ws("::", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    said = X.first_text(F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).otherwise(" "), F.col("o_orderstatus"))
    return o.select("o_custkey", X.coerce(F.concat(F.lit(" "), "o_orderstatus"), ("f",), "other").alias("result"), pair["left"].alias("left_end"), pair["right"].alias("right_end"), said.alias("said"), X.quote_in_evidence(F.lit(" URGENT "), "o_orderpriority").alias("quoted"),
                    X.value_type(F.col("o_orderdate").cast("date")).alias("t1"), X.value_type("o_totalprice").alias("t2"), X.value_type("o_orderpriority").alias("t3"))


@add("select event_id, case when event_id % 3 = 2 then null else json_extract_string(props, '$.k') end as k from events")
def greedy_json(spark, sf_dir):
    """JSON objects, some with prose around them, some broken."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).otherwise(F.concat(F.lit("["), F.substring("event_type", 1, 2), F.lit("] {")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_object(said), "$.k").alias("k"))


@add("with r as (select event_id, case when event_type = 'error' then 'ERROR' when event_type = 'view' then '' when event_type = 'click' then 'DEBUG' else 'WARNING' end as level, event_type || ' of ' || user_id as text from events) select event_id from r where level <> 'DEBUG' and contains(text, 'of 1')")
def filtered_records(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "view", "").when(kind == "click", "DEBUG").otherwise("WARNING")
    records = table(spark, sf_dir, "events").select("event_id", level.alias("level"), F.concat(kind, F.lit(" OF "), F.col("user_id").cast("string")).alias("text"))
    return E.filter_records(records, "INFO", "of 1").select("event_id")


@add("with s as (select p_partkey, case when p_size > 40 then 'model' else 'code' end as decided_by, case when p_size % 3 = 0 then null when p_size % 3 = 1 then 'match' else 'mismatch' end as code_result, case when p_size > 40 then 'match' when p_size % 3 = 0 then 'unknown' when p_size % 3 = 1 then 'match' else 'mismatch' end as result, p_brand from part), n as (select *, count(*) over (partition by p_brand, decided_by) as c from s) select count(*) as total, count(*) filter (where decided_by = 'model') as by_model, count(*) filter (where c > 1) as several, count(*) filter (where code_result is not null and result <> code_result) as overridden from n")
def compare_stats(spark, sf_dir):
    size = F.col("p_size")
    code = F.when(size % 3 == 1, "match").when(size % 3 == 2, "mismatch")
    p = table(spark, sf_dir, "part").select(F.when(size > 40, "model").otherwise("code").alias("decided_by"), code.alias("code_result"), F.when(size > 40, "match").otherwise(F.coalesce(code, F.lit("unknown"))).alias("result"), "p_brand")
    return V.compare_stats(p.withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy("p_brand", "decided_by"))))


@add("select p_partkey as fact_id, case when p_size % 2 = 0 then 'quantitative' when p_size % 3 = 0 then 'qualitative' else 'descriptive' end as fact_type from part")
def fact_types(spark, sf_dir):
    size = F.col("p_size")
    attributes = V.attributes(size=(F.when(size % 2 == 0, size), "mm"), colour=(F.when(size % 3 == 0, F.col("p_name")), ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), V.fact_type(attributes).alias("fact_type"))


@add("select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def newest_runs(spark, sf_dir):
    return M.newest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")
