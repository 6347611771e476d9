"""Lines of reports, counts with zeros, counters of calls, units of progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as U
from ..plans import report as R
from ._tables import Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: Customers are items, judged by their balance; their orders are the candidates, the dearest first.
_ITEMS = """
    items AS (
      SELECT c_custkey AS item_id, c_custkey AS pos, 'c' || c_custkey AS label, c_mktsegment || ' no ' || c_custkey AS text,
        CASE WHEN c_acctbal < 0 THEN 'different' WHEN c_acctbal < 3000 THEN 'partial' WHEN c_acctbal < 6000 THEN 'same' ELSE 'not_found' END AS verdict,
        CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'balance ' || floor(c_acctbal)::BIGINT END AS reasoning
      FROM customer
    ),
    cand AS (SELECT o_custkey AS item_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice, o_orderpriority FROM orders),
    best AS (SELECT item_id, max(id) FILTER (WHERE rank = 1) AS first, string_agg('o' || id, '<br>' ORDER BY rank) FILTER (WHERE rank <= 2) AS sources FROM cand GROUP BY 1),
    rows AS (SELECT i.*, row_number() OVER (ORDER BY pos) AS n, b.first, coalesce(b.sources, '-') AS found, CASE WHEN reasoning = '' THEN '-' ELSE reasoning END AS said FROM items i LEFT JOIN best b USING (item_id))"""


def _items(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    cand = o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("candidate_id"), rank.alias("rank"), (F.col("o_totalprice") / 1_000_000).alias("score"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderpriority").alias("text"))
    ordered = lambda what, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("rank", what.alias("v"))))), lambda x: x["v"])
    per = cand.groupBy("item_id").agg(ordered(F.col("candidate_id").cast("string"), F.col("rank") == 1).alias("matched_ids"), ordered(F.col("label"), F.col("rank") <= 2).alias("sources"))
    verdict = F.when(balance < 0, "different").when(balance < 3000, "partial").when(balance < 6000, "same").otherwise("not_found")
    items = c.select(
        key.alias("item_id"), key.alias("pos"), F.concat(F.lit("c"), key.cast("string")).alias("label"), F.concat("c_mktsegment", F.lit(" no "), key.cast("string")).alias("text"), verdict.alias("verdict"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("balance "), F.floor(balance).cast("string"))).alias("reasoning"),
    )
    return items.join(per, "item_id", "left"), cand


@add(f"""WITH {_ITEMS}, c AS (SELECT unnest(['same', 'partial', 'different', 'unknown', 'not_found']) AS v, generate_subscripts(['same', 'partial', 'different', 'unknown', 'not_found'], 1) AS k),
    counted AS (SELECT c.k, c.v, count(i.item_id) AS n FROM c LEFT JOIN items i ON i.verdict = c.v GROUP BY ALL)
    SELECT 1 AS section, 0 AS n, 0 AS k, '- ' || sum(n) || ' results: ' || string_agg(v || ' ' || n, ', ' ORDER BY k) AS line FROM counted
    UNION ALL SELECT 2, 0, k - 1, l FROM (SELECT unnest(['## Summary', '', '| # | item | verdict | source | in short |', '|---|---|---|---|---|']) AS l, generate_subscripts([1, 2, 3, 4], 1) AS k)
    UNION ALL SELECT 3, n, 0, '| ' || n || ' | ' || text || ' | ' || verdict || ' | ' || found || ' | ' || said || ' |' FROM rows
    UNION ALL SELECT 4, n, k - 1, l FROM (SELECT n, unnest(['### ' || n || '. ' || label || ' - ' || verdict, '', '**Item**: ' || text, '**Found in**: ' || found, '**Why**: ' || said]) AS l, generate_subscripts([1, 2, 3, 4, 5], 1) AS k FROM rows)
    UNION ALL SELECT 4, r.n, 100000 + rank, '- (' || printf('%.3f', o_totalprice / 1000000) || ') o' || id || CASE WHEN id = r.first THEN ' <- matched' ELSE '' END || ': ' || o_orderpriority FROM cand JOIN rows r USING (item_id)""")
def item_report_lines(spark, sf_dir):
    return R.item_report(*_items(spark, sf_dir))


@add(f"WITH {_ITEMS} SELECT n, text AS item, verdict, replace(found, '<br>', '; ') AS sources FROM rows")
def summary_rows(spark, sf_dir):
    return R.summary_rows(_items(spark, sf_dir)[0])


@add(f"""WITH {_ITEMS}, c AS (SELECT unnest(['same', 'partial', 'different', 'unknown', 'not_found']) AS v, generate_subscripts(['same', 'partial', 'different', 'unknown', 'not_found'], 1) AS k)
    SELECT k - 1 AS ord, v AS verdict, count(i.item_id) AS n FROM c LEFT JOIN items i ON i.verdict = c.v GROUP BY ALL""")
def item_verdict_counts(spark, sf_dir):
    return R.counts_with_zeros(_items(spark, sf_dir)[0], "verdict", R.ITEM_RESULTS)


@add("""SELECT l_orderkey, count(*) AS calls, count(*) FILTER (WHERE l_linenumber > 1) AS retries, count(*) FILTER (WHERE l_returnflag = 'R') AS parse_failures,
      count(*) FILTER (WHERE l_linestatus = 'O') AS structured_calls FROM lineitem GROUP BY 1""")
def runner_stats(spark, sf_dir):
    """Lines of an order as attempts of one call."""
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), F.when(F.col("l_returnflag") == "R", "parse").otherwise("ok").alias("status"), (F.col("l_linestatus") == "O").alias("structured"))
    return U.runner_stats(calls, "l_orderkey")


@add("""WITH f AS (SELECT s_suppkey AS pos, s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '.XLSX' ELSE '.docx' END AS name FROM supplier)
    SELECT 0 AS a, pos AS b, 'doc:' || pos AS key, name AS label, 'doc' AS kind, CASE WHEN name LIKE '%.XLSX' THEN 5 ELSE 4 END AS parts FROM f
    UNION ALL SELECT 1, 0, 'concept', 'concepts', 'concept', 1
    UNION ALL SELECT 2, pos, 'compare:' || name || CASE WHEN k > 1 THEN '#' || k ELSE '' END, name, 'compare', 1
      FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM f WHERE pos > 0)""")
def run_units(spark, sf_dir):
    """Units of a run that compares the first supplier's sheet with the files of all others."""
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/in/"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".XLSX").otherwise(".docx"))
    return U.progress_units(s.select(F.col("s_suppkey").alias("pos"), path.alias("path")))


@add("SELECT p_partkey, CASE WHEN p_size % 5 > 0 AND p_size % 4 > 0 THEN (p_size % 4 + 1) * 120 * (p_size % 3 + 1) + (p_size % 3) * (p_size % 5) * 10 END AS seconds FROM part")
def retry_estimates(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", U.worst_case_seconds(F.lit(120), size % 4, size % 3, size % 5 * 10).alias("seconds"))


@add("""WITH t AS (SELECT '## [' || printf('%09d', doc_id) || ']' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, doc_id FROM documents WHERE regexp_matches(text, '\\S'))
    SELECT md5(rtrim(substring(string_agg(t, chr(10) || chr(10) ORDER BY doc_id), 1, 12000)) || chr(10) || '…') AS digest FROM t""")
def knowledge_digest(spark, sf_dir):
    """All documents as notes under headers, cut where the reader's room ends."""
    notes = table(spark, sf_dir, "documents").select(F.format_string("%09d", "doc_id").alias("name"), "text")
    return U.knowledge_text(notes).select(F.md5("text").alias("digest"))
