"""Ontology, candidate pairs and concept graphs over parts, lines of orders, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as D
from ..operators import graph as G
from ..operators.ordering import shuffled
from ._tables import NORM, TOKENS, Registry, node, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: A part is related to the next one; alias groups are a part's name and its number.
_ONTOLOGY = f"""
    entries as (select a.p_partkey as pos, 'Part ' || a.p_partkey as l, 'Part ' || b.p_partkey as r, case when a.p_partkey % 3 = 0 then 'differs_by' else 'same_as' end as relation, a.p_brand as axis from part a join part b on b.p_partkey = a.p_partkey + 1),
    al as (select p_partkey as g, {NORM.format("'Part ' || p_partkey")} as name from part union select p_partkey, {NORM.format("'no ' || p_partkey")} from part),
    sides as (select pos, relation, axis, lf.name as lform, rf.name as rform, la.g as lg, ra.g as rg from entries e join al la on la.name = {NORM.format('e.l')} join al ra on ra.name = {NORM.format('e.r')} join al lf on lf.g = la.g join al rf on rf.g = ra.g),
    onto as (select least(lform, rform) as name_lo, greatest(lform, rform) as name_hi, arg_max(relation, (case when relation = 'differs_by' then 1 else 0 end) * 1000000000 + pos) as relation, arg_max(axis, (case when relation = 'differs_by' then 1 else 0 end) * 1000000000 + pos) as axis from sides where lform <> rform and lg <> rg group by 1, 2)"""


def _named(key: str):
    return F.concat(F.lit("Part "), F.col(key).cast("string"))


def ontology(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), _named("p_partkey").alias("right"))
    relation = F.when(F.col("p_partkey") % 3 == 0, "differs_by").otherwise("same_as")
    entries = p.join(shuffled(following), "p_partkey").select(F.col("p_partkey").alias("pos"), _named("p_partkey").alias("left"), "right", relation.alias("relation"), F.col("p_brand").alias("axis"))
    aliases = p.select(F.col("p_partkey").alias("group_id"), F.explode(F.array(_named("p_partkey"), F.concat(F.lit("no "), F.col("p_partkey").cast("string")))).alias("name"))
    return G.expand_ontology(entries, aliases)


@add(f"with {_ONTOLOGY} select * from onto")
def ontology_expand(spark, sf_dir):
    return ontology(spark, sf_dir)


@add(f"""with {_ONTOLOGY}, ways as (select relation, axis, name_lo as r, name_hi as t from onto union all select relation, axis, name_hi, name_lo from onto)
    select p_partkey as ref_id, l_returnflag as doc, l_orderkey * 10 + l_linenumber as target_id, relation, axis from part join ways on r = {NORM.format("'Part ' || p_partkey")} join lineitem on t = {NORM.format("'no-' || l_partkey")}""")
def ontology_augment(spark, sf_dir):
    ref = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), _named("p_partkey").alias("entity_name"))
    target = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.concat(F.lit("no-"), F.col("l_partkey").cast("string")).alias("entity_name"))
    return G.ontology_pairs(ref, target, ontology(spark, sf_dir))


@add(f"""with {_ONTOLOGY}, p as (select l_orderkey * 10 + l_linenumber as pair_id, {NORM.format("'part ' || l_partkey")} as l, {NORM.format("'Part-' || (l_partkey + l_linenumber % 3)")} as r from lineitem)
    select pair_id, case when o.relation is not null then o.relation when l = r then 'same_as' else 'unknown' end as relation, case when o.relation is not null then 'ontology' when l = r then 'code' else '' end as decided_by from p left join onto o on name_lo = least(l, r) and name_hi = greatest(l, r)""")
def resolve_known(spark, sf_dir):
    right = F.concat(F.lit("Part-"), (F.col("l_partkey") + F.col("l_linenumber") % 3).cast("string"))
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("left_name"), right.alias("right_name"))
    return G.resolve_known(pairs, ontology(spark, sf_dir)).select("pair_id", "relation", "decided_by")


#: Lines of an order are nodes; a line is linked to the next one of the same return flag.
_EDGES = "n as (select l_orderkey * 10 + l_linenumber as a, lead(l_orderkey * 10 + l_linenumber) over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey) as b from lineitem), e as (select a, b from n where b is not null)"


def _edges(spark, sf_dir):
    from pyspark.sql import Window

    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    after = F.lead(line).over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(line.alias("a"), after.alias("b")).where("b is not null")


@add(f"""with recursive {_EDGES}, g as (select a, b from e union select b, a from e), r(node, seen) as (select a, a from g union select r.node, g.b from r join g on r.seen = g.a)
    select node, min(seen) as component from r group by node""")
def concept_components(spark, sf_dir):
    return G.components(_edges(spark, sf_dir).select("a", "b"))


@add("select distinct a.o_custkey as concept_id, a.o_orderstatus as doc, a.o_orderkey as fact_id, b.o_orderstatus as other_doc, b.o_orderkey as other_id from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderstatus <> b.o_orderstatus")
def partners(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("concept_id"), F.col("o_orderstatus").alias("doc"), F.col("o_orderkey").alias("fact_id"))
    return G.partners(members)


_RELATED = "r as (select l_partkey as left_id, l_suppkey + 1000000 as right_id, case when l_returnflag = 'R' then 'differs_by' else 'same_as' end as relation, l_orderkey * 10 + l_linenumber as pos from lineitem)"


def _related(spark, sf_dir):
    relation = F.when(F.col("l_returnflag") == "R", "differs_by").otherwise("same_as")
    return table(spark, sf_dir, "lineitem").select(node(0, F.col("l_partkey")).alias("left_id"), node(1, F.col("l_suppkey") + 1_000_000).alias("right_id"), relation.alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


@add(f"with {_RELATED} select left_id as lo, right_id as hi, count(*) filter (where relation = 'same_as') as same, count(*) filter (where relation = 'differs_by') as differs from r group by 1, 2 having count(*) filter (where relation = 'same_as') > 0 and count(*) filter (where relation = 'differs_by') > 0")
def contradictions(spark, sf_dir):
    return G.contradictions(_related(spark, sf_dir)).select(F.col("lo.id").alias("lo"), F.col("hi.id").alias("hi"), "same", "differs")


@add(f"with {_RELATED} select distinct * from r where left_id not in (select p_partkey from part where p_size < 45)")
def dangling_edges(spark, sf_dir):
    edges = _related(spark, sf_dir)
    members = table(spark, sf_dir, "part").where("p_size < 45").select(node(0, F.col("p_partkey")).alias("fact_id")).union(edges.select("right_id"))
    return G.dangling(edges, members).select(F.col("left_id.id").alias("left_id"), F.col("right_id.id").alias("right_id"), "relation", "pos")


@add()
def constrained_merge(spark, sf_dir):
    """Lines of an order: the next line is the same concept, or apart where both were returned (an ordered fold per order, so no SQL)."""
    from pyspark.sql import Window

    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    window = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem").select(line.alias("left_id"), F.lead(line).over(window).alias("right_id"), F.lead(line, 2).over(window).alias("third"), "l_returnflag", "l_linestatus")  # noqa: E741
    relation = F.when(F.col("l_returnflag") == "R", "differs_by").otherwise("same_as")
    near = F.struct((F.col("left_id") * 2).alias("pos"), "left_id", "right_id", F.lit("same_as").alias("relation"), (F.col("l_linestatus") == "F").alias("promoted"))
    far = F.struct((F.col("left_id") * 2 + 1).alias("pos"), "left_id", F.col("third").alias("right_id"), relation.alias("relation"), F.lit(False).alias("promoted"))
    edges = l.select(F.explode(F.array(near, far)).alias("e")).select("e.*").where("right_id is not null")
    return G.constrained_merge(edges, table(spark, sf_dir, "lineitem").select(line.alias("id")))


@add("""with m as (select o_custkey as root, min(o_orderkey) as first, arg_min(o_orderpriority, o_orderkey) as label, count(distinct o_orderstatus) as n_docs from orders group by 1), n as (select *, row_number() over (order by first) as concept_no from m) select *, 'c-' || lpad(concept_no::varchar, greatest(4, length(concept_no::varchar))::int, '0') as node_id from n""")
def concept_nodes(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("entity_name"), F.col("o_orderstatus").alias("doc"))
    return G.concept_nodes(members)


@add(f"""with c as (select conv_id, turn, role as name, text as quote, lag(text) over (partition by conv_id order by turn) as evidence from conversations),
    t as (select conv_id, turn, quote, list_distinct({TOKENS.format('quote')}) as q, list_distinct({TOKENS.format('evidence')}) as e, list_distinct({TOKENS.format('name')}) as n, list_distinct({TOKENS.format("evidence || ' ' || name")}) as src from c where evidence is not null)
    select conv_id, turn, trim(quote) <> '' and (len(q) > 0 and len(list_intersect(q, src)) / len(q)::double >= 0.8) and (len(q) >= 3 or (len(q) > 0 and ((len(list_intersect(q, e)) = len(q) and len(q) = len(e)) or (len(n) > 0 and len(list_intersect(n, q)) = len(n))))) as verified from t""")
def verify_quotes(spark, sf_dir):
    """Whether each turn is a quote of the whole turn before it."""
    from .documents import turns_with_previous

    t = turns_with_previous(spark, sf_dir)
    claims = t.select("conv_id", "turn", F.col("text").alias("quote"), F.col("before").alias("evidence_text"), F.lit("").alias("search_text"), F.col("role").alias("entity_name"))
    return G.verify_quotes(claims).select("conv_id", "turn", "verified")


@add(f"""with t as (select conv_id, turn, text from conversations), h as (select conv_id, array_to_string(string_split(text, ' ')[1:3], ' ') as name from t where turn = 0),
    m as (select b.conv_id, b.turn, {NORM.format('name')} as n, {NORM.format('text')} as block, list_filter({TOKENS.format('name')}, lambda x: length(x) >= 2) as w, {TOKENS.format('text')} as bt from h join t b on b.conv_id = h.conv_id and b.turn > 0 and b.turn % 4 <> 2)
    select conv_id, turn from m where (n <> '' and contains(block, n)) or len(list_intersect(w, bt)) > 0""")
def mentions(spark, sf_dir):
    """Turns of a conversation that mention what it begins with; every fourth turn counts as cited."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("block_text"))
    entities = turns.where("turn = 0").select("conv_id", F.substring_index("block_text", " ", 3).alias("entity_name"))
    return D.mentions(entities, turns.where("turn > 0"), turns.where("turn % 4 = 2"), "conv_id", "turn").select("conv_id", "turn").distinct()


@add("""with e as (select l_orderkey * 10 + l_linenumber as edge_id, case when l_returnflag = 'R' then 'differs_by' else 'same_as' end as relation, l_quantity < 25 as verified, l_linestatus as reason from lineitem),
    d as (select case when relation = 'same_as' and not verified then 'unknown' else relation end as relation, case when relation = 'same_as' and not verified then 'evidence' else '' end as rejected_by, case when relation = 'same_as' and not verified then '[evidence] ' || reason else reason end as reason from e)
    select relation, rejected_by, reason, count(*) as n from d group by all""")
def demoted_edges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    edges = l.select(F.when(F.col("l_returnflag") == "R", "differs_by").otherwise("same_as").alias("relation"), (F.col("l_quantity") < 25).alias("verified"), F.col("l_linestatus").alias("reason"))
    return G.demote_unproven(edges).groupBy("relation", "rejected_by", "reason").agg(F.count(F.lit(1)).alias("n"))


@add("select count(*) filter (where l_returnflag <> 'R' and l_quantity < 25) as same_as, count(*) filter (where l_returnflag = 'R') as differs_by, count(*) filter (where l_returnflag <> 'R' and not l_quantity < 25) as unknown, count(*) filter (where l_returnflag <> 'R' and not l_quantity < 25) as rejected_evidence from lineitem")
def graph_stats(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    edges = l.select(F.when(F.col("l_returnflag") == "R", "differs_by").otherwise("same_as").alias("relation"), (F.col("l_quantity") < 25).alias("verified"), F.col("l_linestatus").alias("reason"))
    return G.graph_stats(G.demote_unproven(edges))
