"""Text rules over documents, pages and conversations; batches; reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import as_number
from ..operators import batches as B
from ..operators import facts as V
from ._tables import NORM, TOKENS, Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

_VALUES = """values_ as (
    select o_orderkey as id, case o_orderkey % 5 when 0 then '₩' || format('{:,}', floor(o_totalprice)::bigint) when 1 then (floor(o_totalprice)::bigint)::varchar || '.50%' when 2 then '  ' || (floor(o_totalprice)::bigint)::varchar || '.00 kg ' when 3 then o_orderpriority else '+' || (floor(o_totalprice)::bigint)::varchar end as raw from orders)"""


def _values(spark, sf_dir):
    whole = F.floor("o_totalprice").cast("bigint")
    raw = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("₩"), F.format_number(whole, 0)))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(whole.cast("string"), F.lit(".50%")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("  "), whole.cast("string"), F.lit(".00 kg ")))
        .when(F.col("o_orderkey") % 5 == 3, F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("+"), whole.cast("string")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@add(f"""with {_VALUES}, c as (select id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as s from values_),
    p as (select id, s, regexp_extract(s, '^[₩$€¥£]?\\s*([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(%|[가-힣A-Za-z]{{1,3}})?$', 1) as num, regexp_extract(s, '^[₩$€¥£]?\\s*([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(%|[가-힣A-Za-z]{{1,3}})?$', 2) as unit from c)
    select id, case when num = '' then s else case when contains(num, '.') then regexp_replace(replace(num, ',', ''), '\\.?0+$', '') else replace(num, ',', '') end || unit end as value from p""")
def normalize_value(spark, sf_dir):
    return _values(spark, sf_dir).select("id", X.normalize_value("raw").alias("value"))


@add(f"with {_VALUES} select id, try_cast(replace(trim(raw), ',', '') as double) as value from values_")
def as_number_values(spark, sf_dir):
    return _values(spark, sf_dir).select("id", as_number("raw").alias("value"))


def _letters_sql(n: str) -> str:
    firsts = [sum(26**j for j in range(k + 1)) for k in range(6)]
    return " || ".join(f"case when {n} >= {firsts[k]} then chr((65 + (({n} - {firsts[k]}) // {26**k}) % 26)::int) else '' end" for k in reversed(range(6)))


@add(f"select o_orderkey as id, case when o_totalprice = floor(o_totalprice) then (o_totalprice::bigint)::varchar else 'fraction' end as value, {_letters_sql('o_custkey')} as letters, case when o_custkey < 1 then 1000000000 else o_custkey end as back from orders")
def cell_addresses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    whole = F.col("o_totalprice") == F.floor("o_totalprice")
    letters = X.column_letters("o_custkey")
    return o.select(F.col("o_orderkey").alias("id"), F.when(whole, X.cell_text("o_totalprice")).otherwise("fraction").alias("value"), letters.alias("letters"), X.column_number(letters).cast("long").alias("back"))


@add("""select doc_id, case when length(s) > 80 then substring(s, 1, 80) || '…' else s end as preview, case when length(text) > 60 then substring(text, 1, 59) || '…' else text end as cut, length(text) > 400 as folded
    from (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from documents)""")
def previews(spark, sf_dir):
    folded = X.fold("text", 200, 200)
    return table(spark, sf_dir, "documents").select("doc_id", X.preview("text").alias("preview"), X.truncate("text", 60).alias("cut"), (folded != F.col("text")).alias("folded"))


@add("select doc_id, regexp_replace(source || ' ' || lang || '/1', '[^a-zA-Z0-9_\\-]', '_', 'g') as slug, lower(regexp_replace(source || ' ' || lang, '\\s+', '', 'g')) as squeezed from documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.concat_ws("", "source", F.lit(" "), "lang", F.lit("/1"))).alias("slug"), X.squeeze(F.concat_ws(" ", "source", "lang")).alias("squeezed"))


@add(f"""with n as (select {NORM.format('p_name')} as name, min(p_partkey) as first from part group by 1)
    select p_partkey as ref_id, first as target_id from part join n on {NORM.format("p_name || ' '")} = name where name <> ''""")
def norm_name_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ref = p.select(F.col("p_partkey").alias("ref_id"), F.concat(F.upper("p_name"), F.lit(" -")).alias("entity_name"))
    target = p.select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("entity_name"), F.col("p_partkey").alias("pos"))
    return V.match_by_name(ref, target).select("ref_id", F.col("target.fact_id").alias("target_id"))


_CONV = "c as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations)"


@add(f"with {_CONV} select conv_id, turn, pos::bigint as pos, (pos // 3)::int as batch from c")
def batch_assign(spark, sf_dir):
    return B.number_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "batch")


@add(f"""with {_CONV}, b as (select conv_id, (pos // 3)::int as batch, list(role || ':' || turn order by pos) as items from c group by 1, 2),
    l as (select conv_id, batch, lag(items) over (partition by conv_id order by batch) as prev from b)
    select conv_id, batch, coalesce(array_to_string(prev[-2:], ' '), '') as context from l""")
def context_prepend(spark, sf_dir):
    batched = B.number_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3)
    item = F.concat_ws(":", "role", F.col("turn").cast("string"))
    return B.previous_context(batched, "conv_id", item, 2).select("conv_id", "batch", F.array_join("context", " ").alias("context"))


@add("""with n as (select o_custkey, o_orderdate, o_orderkey, case when o_orderstatus = 'O' then '' else o_orderpriority end as v, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders),
    b as (select o_custkey, (pos // 4)::int as batch, arg_max(v, pos) filter (where v <> '') as v from n group by 1, 2)
    select o_custkey, batch, coalesce(last_value(v ignore nulls) over (partition by o_custkey order by batch rows between unbounded preceding and 1 preceding), '') as carried from b""")
def carry_over(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")))
    return B.carry_over(B.number_batches(o, "o_custkey", "o_orderkey", 4), "o_custkey", "v")


@add("""with recursive g as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn, length(text)::bigint as n from conversations),
    f as (select conv_id, k, turn, n, n as used, 0 as batch from g where k = 1 union all
          select g.conv_id, g.k, g.turn, g.n, case when f.used > 0 and f.used + g.n > 1500 then g.n else f.used + g.n end, case when f.used > 0 and f.used + g.n > 1500 then f.batch + 1 else f.batch end from f join g on g.conv_id = f.conv_id and g.k = f.k + 1)
    select conv_id, turn, n, batch::int as batch from f""")
def greedy_pack(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return B.pack_groups(c, "conv_id", "turn", "n", 1500)


@add("select doc_id, source, case when n = 1 then source else source || '#' || n end as unit_key from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents)")
def occurrence_keys(spark, sf_dir):
    return B.occurrence_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@add("""with g as (select conv_id, turn, role, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as record from conversations)
    select conv_id, record::bigint as record, string_agg(role || ' ' || turn, chr(10) order by turn) as text from g group by 1, 2""")
def log_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("line"))
    return B.group_records(c, "conv_id", "turn", "line", "^user ")


_BLOCKS = """blocks as (select page_id as doc, n as block_id, regexp_replace(b, '<[^>]*>', '', 'g') as block_text from (
    select page_id, unnest(list_filter(string_split(html, chr(10)), lambda x: contains(x, '<p') or contains(x, '<h1'))) as b, generate_subscripts(list_filter(string_split(html, chr(10)), lambda x: contains(x, '<p') or contains(x, '<h1')), 1) as n from pages))"""


def page_blocks(spark, sf_dir):
    """Lines of a page that hold a heading or a paragraph, numbered, without tags."""
    lines = F.filter(F.split("html", "\n"), lambda x: F.contains(x, F.lit("<p")) | F.contains(x, F.lit("<h1")))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(lines).alias("n", "b"))
    return p.select("doc", (F.col("n") + 1).cast("long").alias("block_id"), F.regexp_replace("b", "<[^>]*>", "").alias("block_text"))


@add(f"with {_BLOCKS} select doc, block_id, length(block_text) as n_chars, md5(block_text) as digest from blocks")
def page_block_texts(spark, sf_dir):
    return page_blocks(spark, sf_dir).select("doc", "block_id", F.length("block_text").cast("long").alias("n_chars"), F.md5(F.col("block_text").cast("binary")).alias("digest"))


@add(f"""with {_BLOCKS}, cited as (select doc, block_id, fact_id from (select doc, block_id, unnest({TOKENS.format('block_text')}) as fact_id from blocks) where length(fact_id) > 9 group by all)
    select b.doc, b.block_id, count(c.fact_id) as n_facts from blocks b left join cited c on b.doc = c.doc and b.block_id = c.block_id group by 1, 2""")
def facts_by_block(spark, sf_dir):
    blocks = page_blocks(spark, sf_dir)
    cited = blocks.select("doc", "block_id", F.explode(X.tokens("block_text")).alias("fact_id")).where("length(fact_id) > 9")
    return V.facts_by_block(blocks, cited)


@add(f"""with {_BLOCKS}, lines as (select doc, block_id, unnest(string_split(block_text, '. ')) as l, generate_subscripts(string_split(block_text, '. '), 1) as line_id from blocks),
    t as (select doc, block_id, line_id, trim(regexp_replace(l, '\\s+', ' ', 'g')) as l from lines),
    ev as (select doc, block_id, l as e from t where line_id % 3 = 2 union select doc, block_id, trim(regexp_replace(block_text, '\\s+', ' ', 'g')) from blocks where block_id % 4 = 1)
    select t.doc, t.block_id, t.line_id, coalesce(bool_or(least(length(l), length(e)) >= 3 and (contains(e, l) or contains(l, e))), false) as covered
    from t left join ev on t.doc = ev.doc and t.block_id = ev.block_id group by all""")
def line_coverage(spark, sf_dir):
    blocks = page_blocks(spark, sf_dir)
    lines = blocks.select("doc", "block_id", F.posexplode(F.split("block_text", r"\. ")).alias("k", "raw_text")).select("doc", "block_id", (F.col("k") + 1).cast("long").alias("line_id"), "raw_text")
    # every third line is a fact's evidence, and of every fourth block the whole text
    cited = lines.where("line_id % 3 = 2").select("doc", "block_id", F.col("raw_text").alias("evidence_text"))
    return V.line_coverage(lines, cited.unionByName(blocks.where("block_id % 4 = 1").select("doc", "block_id", F.col("block_text").alias("evidence_text"))))


_TURNS = f"t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations), k as (select conv_id, turn, list_distinct({TOKENS.format('text')}) as claim, {TOKENS.format('before')} as src from t where before is not null)"


def turns_with_previous(spark, sf_dir):
    """Each turn of a conversation with the whole turn before it."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", before.alias("before")).where("before is not null")


@add(f"with {_TURNS} select conv_id, turn, round(case when len(claim) = 0 then 0.0 else len(list_intersect(claim, src)) / len(claim)::double end, 6) as coverage from k")
def evidence_coverage(spark, sf_dir):
    return turns_with_previous(spark, sf_dir).select("conv_id", "turn", F.round(V.evidence_coverage(F.col("text"), F.col("before")), 6).alias("coverage"))


@add(f"with {_TURNS}, u as (select conv_id, turn, list_sort(list_filter(claim, lambda x: not list_contains(src, x))) as lost from k) select conv_id, turn, len(lost) as n_unseen, array_to_string(lost[1:5], ' ') as samples from u")
def unseen_tokens(spark, sf_dir):
    """Tokens of a claim that its source lacks: how many, and five of them."""
    lost = F.array_sort(F.array_except(F.array_distinct(X.tokens("text")), X.tokens("before")))
    return turns_with_previous(spark, sf_dir).select("conv_id", "turn", lost.alias("lost")).select("conv_id", "turn", F.size("lost").cast("long").alias("n_unseen"), F.array_join(F.slice("lost", 1, 5), " ").alias("samples"))


@add(f"""with f as (select doc_id * 100000 + n as fact_id, substring(text, n * 800 + 1, 800) as text from (select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 800.0)::bigint))) as n from documents)),
    ft as (select fact_id, list_distinct({TOKENS.format('text')}) as t from f), gt as (select item_id, list_distinct({TOKENS.format('text')}) as a from benchmark),
    s as (select item_id, fact_id, round(len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t)))::double, 6) as overlap from gt cross join ft)
    select item_id as golden_id, fact_id, overlap from (select *, row_number() over (partition by item_id order by overlap desc, fact_id) as n from s where overlap >= 0.3) where n = 1""")
def golden_truth(spark, sf_dir):
    """The chunk of any whole document that overlaps most with each benchmark passage."""
    from ..operators.diagnose import best_overlap

    golden = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("golden_id"), F.col("text").alias("golden_text"))
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks("text")).alias("n", "fact_text"))
    return best_overlap(golden, cut.select((F.col("doc_id") * 100_000 + F.col("n")).alias("fact_id"), "fact_text"))


@add("""with j as (select quality, toxic from labels), c as (select a.v as quality, b.v as toxic from (values (0), (1)) a(v), (values (0), (1)) b(v))
    select c.quality, c.toxic, count(j.quality) as n from c left join j on j.quality = c.quality and j.toxic = c.toxic group by 1, 2""")
def confusion_matrix(spark, sf_dir):
    from ..operators.diagnose import confusion

    return confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@add("""with s as (select source, list(n_chars order by n_chars) as v from documents group by source) select source, v[(len(v) // 2) + 1] as median from s""")
def upper_median(spark, sf_dir):
    from ..operators.diagnose import upper_median as median

    return median(table(spark, sf_dir, "documents"), "source", "n_chars")


@add("select source || ' ' || lang as title, '| ' || source || ' | ' || lang || ' | ' || count(*) || ' |' as line from documents group by source, lang")
def report_lines(spark, sf_dir):
    from ..functions.text import table_line

    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat_ws(" ", "source", "lang").alias("title"), table_line("source", "lang", "n").alias("line"))
