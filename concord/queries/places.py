"""Places of facts: cells in ranges, ids that exist, units and lines of documents, compact documents, records as facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import column_letters
from ..operators import places as P
from ._tables import Registry, table
from .documents import _BLOCKS, page_blocks

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: Lines are cells of a sheet per line status, a row per order; orders name ranges that begin at their own row.
_CELLS = """
    cells AS (SELECT DISTINCT l_returnflag AS doc, l_linestatus AS sheet, l_orderkey::INT AS "row", l_linenumber::INT AS col FROM lineitem),
    claims AS (
      SELECT ['A', 'N', 'R'][o_orderkey % 3 + 1] AS doc, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'F' END AS sheet, o_orderkey AS fact_id,
        o_orderkey AS row1, o_orderkey + o_custkey % 90 AS row2, o_custkey % 3 + 1 AS col1, o_custkey % 3 + 2 AS col2, o_custkey % 11 = 0 AS bare
      FROM orders WHERE o_custkey % 13 <> 0
    ),
    cited AS (
      SELECT DISTINCT c.doc, c.sheet, k.fact_id, c."row", c.col FROM cells c JOIN claims k ON c.doc = k.doc AND c.sheet = k.sheet
        AND (CASE WHEN bare THEN c."row" = row1 ELSE c."row" BETWEEN row1 AND row2 AND c.col BETWEEN col1 AND col2 END)
    )"""


def _cells(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_returnflag").alias("doc"), F.col("l_linestatus").alias("sheet"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"))


def _ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    to = F.concat(F.lit("$"), column_letters(c % 3 + 2), F.lit("$"), (k + c % 90).cast("string"))
    where = F.when(c % 13 == 0, "nowhere").when(c % 11 == 0, k.cast("string")).otherwise(F.concat(column_letters(c % 3 + 1), k.cast("string"), F.lit(":"), to))
    doc = F.element_at(F.array(*map(F.lit, "ANR")), (k % 3 + 1).cast("int"))
    return o.select(doc.alias("doc"), F.when(F.col("o_orderstatus") == "O", "O").otherwise("F").alias("sheet"), k.alias("fact_id"), where.alias("cell_range"))


@add(f"WITH {_CELLS} SELECT * FROM cited")
def cited_cells(spark, sf_dir):
    return P.cited_cells(_ranges(spark, sf_dir), _cells(spark, sf_dir).distinct())


@add(f"""WITH {_CELLS}, m AS (SELECT c.*, EXISTS (SELECT 1 FROM cited k WHERE k.doc = c.doc AND k.sheet = c.sheet AND k."row" = c."row" AND k.col = c.col) AS held FROM cells c),
    r AS (SELECT doc, sheet, "row", count(*) AS n, count(*) FILTER (WHERE held) AS c FROM m GROUP BY ALL)
    SELECT doc, sheet, sum(n)::BIGINT AS n_cells, sum(c)::BIGINT AS n_cited, count(*) FILTER (WHERE c = 0) AS n_uncited_rows FROM r GROUP BY ALL""")
def cell_coverage(spark, sf_dir):
    return P.sheet_coverage(_ranges(spark, sf_dir), _cells(spark, sf_dir))


#: Customers cite the orders that they are said to have; a customer's own orders are the places that exist.
_PLACES = """
    claims AS (SELECT o_custkey AS doc, o_orderpriority AS fact_id, list(o_orderkey - o_orderkey % 2 ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL),
    known AS (SELECT o_custkey AS doc, list(DISTINCT o_orderkey) AS ids FROM orders GROUP BY ALL),
    rebuilt AS (
      SELECT c.doc, c.fact_id, list_filter(c.ids, lambda x: list_contains(k.ids, x)) AS block_ids,
        list_sort(list_distinct(list_filter(c.ids, lambda x: NOT list_contains(k.ids, x)))) AS lost
      FROM claims c JOIN known k ON k.doc = c.doc
    )"""


def _claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey")))
    cited = o.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("fact_id")).agg(F.transform(ordered, lambda x: x["o_orderkey"] - x["o_orderkey"] % 2).alias("block_ids"))
    return cited, o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("block_id"))


@add(f"WITH {_PLACES} SELECT doc, fact_id, array_to_string(block_ids, ',') AS kept, array_to_string(lost, ',') AS lost, len(block_ids) = 0 AS orphan FROM rebuilt")
def rebuilt_sources(spark, sf_dir):
    claims, places = _claims(spark, sf_dir)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = P.rebuild_sources(claims, ["fact_id"], "block_ids", places.withColumnRenamed("block_id", "id"))
    return rows.select("doc", "fact_id", joined("block_ids").alias("kept"), joined("lost").alias("lost"), "orphan")


@add(f"WITH {_PLACES} SELECT doc, fact_id FROM rebuilt WHERE len(block_ids) = 0")
def facts_without_block(spark, sf_dir):
    return P.facts_without_block(*_claims(spark, sf_dir))


@add("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS n FROM d),
    k AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS ord, count(*) OVER (PARTITION BY doc_id) AS lines FROM l WHERE regexp_matches(raw, '\\S'))
    SELECT doc_id AS doc, printf('%d:l%02d', doc_id, ord) AS line_id, ord::INTEGER AS ord, md5(trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'))) AS digest,
      length(regexp_extract(raw, '^(\\s*)', 1))::INTEGER AS indent
    FROM k WHERE lines > 1""")
def line_index(spark, sf_dir):
    """The lines of every whole document that has more than one."""
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("block_id"), "text")
    return P.line_index(blocks, "text").select("doc", "line_id", "ord", F.md5("raw_text").alias("digest"), "indent")


#: Every second page is read as slides of three shapes, the others as a text document.
_SHAPES = f"{_BLOCKS}, shapes AS (SELECT doc, CASE WHEN doc % 2 = 0 THEN 'ppt' ELSE 'word' END AS doc_type, CASE WHEN doc % 2 = 0 THEN (block_id - 1) // 3 + 1 ELSE 1 END AS container, block_id AS ord, block_id, block_text AS text FROM blocks)"


def _shapes(spark, sf_dir):
    b = page_blocks(spark, sf_dir)
    slides = F.col("doc") % 2 == 0
    return b.select("doc", F.when(slides, "ppt").otherwise("word").alias("doc_type"), F.when(slides, F.floor((F.col("block_id") - 1) / 3) + 1).otherwise(1).alias("container"), F.col("block_id").alias("ord"), "block_id", F.col("block_text").alias("text"))


@add(f"WITH {_SHAPES} SELECT doc, array_to_string(list(block_id ORDER BY block_id), ',') AS blocks FROM shapes GROUP BY doc, CASE WHEN doc_type = 'ppt' THEN container ELSE -ord END")
def reading_units(spark, sf_dir):
    return P.units(_shapes(spark, sf_dir)).select("doc", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"))


@add(f"""WITH {_SHAPES}, items AS (SELECT *, CASE WHEN container = 1 THEN NULL ELSE 'Body' END AS style FROM shapes)
    SELECT doc, doc_type, md5('{{"doc_type":"' || doc_type || '","file_name":' || doc || ',"blocks":[' || string_agg(
      '{{"id":' || block_id || ',"type":"text","text":' || to_json(text) || CASE WHEN style IS NULL THEN '' ELSE ',"style":"Body"' END || '}}', ',' ORDER BY container, ord) || ']}}') AS digest
    FROM items GROUP BY doc, doc_type""")
def compact_documents(spark, sf_dir):
    shapes = _shapes(spark, sf_dir).withColumns({"kind": F.lit("text"), "style": F.when(F.col("container") == 1, None).otherwise("Body"), "name": F.lit(""), "rows": F.lit(None).cast("array<array<string>>")})
    return P.compact_blocks(shapes).select("doc", "doc_type", F.md5("json").alias("digest"))


@add(f"WITH {_SHAPES} SELECT doc, md5(coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE trim(text) <> ''), '')) AS digest FROM shapes GROUP BY doc")
def document_texts(spark, sf_dir):
    return P.all_texts(_shapes(spark, sf_dir)).select("doc", F.md5("text").alias("digest"))


@add("""SELECT 'fact-' || p_partkey AS fact_id, p_type AS fact_type, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END AS entity_name,
      'B' || p_partkey AS cell_range, p_partkey AS "row", '{"A":"' || p_brand || '"' || CASE WHEN p_size > 25 THEN ',"C":"' || p_size || '"' ELSE '' END || '}' AS metadata
    FROM part""")
def records_as_facts(spark, sf_dir):
    """Parts as records of a sheet; columns A and C are metadata, and small parts have no C."""
    p = table(spark, sf_dir, "part")
    cells = F.map_from_arrays(F.when(F.col("p_size") > 25, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("B"))), F.when(F.col("p_size") > 25, F.array("p_brand", "p_name", F.col("p_size").cast("string"))).otherwise(F.array("p_brand", "p_name")))
    records = p.select(
        F.lit("parts").alias("doc"), F.lit("s").alias("sheet"), F.col("p_partkey").alias("row"), F.col("p_partkey").alias("record_id"), F.col("p_type").alias("record_type"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.array(F.lit(""), F.col("p_brand"), F.lit(" ")).alias("path"), F.lit(None).cast("string").alias("attributes"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("cell_range"), F.lit("").alias("evidence_text"),
        P.column_metadata(cells, F.array(F.lit("A "), F.lit("C"), F.lit("Z"))).alias("metadata"),
    )
    return P.records_to_facts(records).select("fact_id", "fact_type", "entity_name", "source.cell_range", "source.row", F.to_json("metadata").alias("metadata"))
