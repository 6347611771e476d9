"""Facts of parts against facts of their line items: matching, verdicts, gate, validation, diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as D
from ..operators import facts as V
from ..operators.ordering import number_rows
from ._tables import NORM, Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: Reference facts are parts; target facts are the quantities of a part's line items, named like the part.
_SCALED = "(least(abs({a}), abs({b})) > 0 and round(log10(greatest(abs({a}), abs({b})) / least(abs({a}), abs({b})))) >= 1 and abs(greatest(abs({a}), abs({b})) / least(abs({a}), abs({b})) - pow(10, round(log10(greatest(abs({a}), abs({b})) / least(abs({a}), abs({b})))))) <= 1e-6 * greatest(abs({a}), abs({b})) / least(abs({a}), abs({b})))"


def _same(a: str, b: str) -> str:
    return f"case when {a} = {b} then true when {_SCALED.format(a=a, b=b)} then null else false end"


FACTS_SQL = f"""
    ref as (select p_partkey as ref_id, p_name as entity_name, {NORM.format('p_name')} as name, p_brand as brand, 1.0 as lo, p_size::double as mid, 50.0 as hi from part),
    tgt0 as (select l_partkey as fact_id, min(l_quantity) as lo, round(avg(l_quantity), 0) as mid, max(l_quantity) as hi, count(*) as n from lineitem group by 1),
    tgt as (select t.*, {NORM.format('p_name')} as name from tgt0 t join part on p_partkey = fact_id),
    first as (select name, arg_min(fact_id, fact_id) as target_id, arg_min(lo, fact_id) as tlo, arg_min(mid, fact_id) as tmid, arg_min(hi, fact_id) as thi, arg_min(n, fact_id) as tn from tgt where name <> '' group by name),
    m as (select ref.*, target_id, tlo, tmid, thi, tn from ref left join first using (name)),
    s as (select *, {_same('lo', 'tlo')} as s1, {_same('mid', 'tmid')} as s2, {_same('hi', 'thi')} as s3, tn is not null and tn < 30 as has_mid from m),
    cmp as (select *, case when target_id is null then 'missing' when s1 is null or s3 is null or (has_mid and s2 is null) then null when s1 and s3 and (not has_mid or s2) then 'match' else 'mismatch' end as code_result,
            case when target_id is null then 0.0 when has_mid then 1.0 else 2 / 3.0 end as coverage from s),
    compared as (select *, coalesce(code_result, 'unknown') as result, case when code_result = 'mismatch' then array_to_string(list_filter([case when s1 = false then 'lower_limit' end, case when has_mid and s2 = false then 'target_value' end, case when s3 = false then 'upper_limit' end], lambda x: x is not null), ',') else '' end as mismatch_attributes from cmp)"""


def reference_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    attributes = V.attributes(lower_limit=(F.lit(1.0), ""), target_value=(F.col("p_size").cast("double"), ""), upper_limit=(F.lit(50.0), ""))
    return p.select(F.lit("parts").alias("doc"), F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("entity_name"), F.col("p_brand").alias("brand"), attributes.alias("attributes"), F.concat_ws(" ", "p_brand", "p_type").alias("evidence_text"), F.col("p_partkey").alias("pos"))


def target_facts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("lo"), F.round(F.avg("l_quantity"), 0).alias("mid"), F.max("l_quantity").alias("hi"), F.count(F.lit(1)).alias("n"))  # noqa: E741
    # parts with many lines state no target value
    attributes = V.attributes(lower_limit=(F.col("lo"), ""), target_value=(F.when(F.col("n") < 30, F.col("mid")), ""), upper_limit=(F.col("hi"), ""))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("entity_name"))
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("lines").alias("doc"), F.col("l_partkey").alias("fact_id"), "entity_name", attributes.alias("attributes"), F.concat_ws(" ", F.lit("n"), "n", "lo", "hi").alias("evidence_text"), F.col("l_partkey").alias("pos"))


def compared_facts(spark, sf_dir):
    return V.compare(V.match_by_name(reference_facts(spark, sf_dir), target_facts(spark, sf_dir)))


@add(f"with {FACTS_SQL} select ref_id, target_id, code_result, mismatch_attributes, round(coverage, 6) as coverage, result from compared")
def verdicts(spark, sf_dir):
    c = compared_facts(spark, sf_dir)
    return c.select(F.col("fact_id").alias("ref_id"), F.col("target.fact_id").alias("target_id"), "code_result", "mismatch_attributes", F.round("coverage", 6).alias("coverage"), "result")


@add(f"with {FACTS_SQL} select r.result, count(c.ref_id) as n from (values ('mismatch'), ('unknown'), ('missing'), ('match')) r(result) left join compared c using (result) group by 1")
def verdict_counts(spark, sf_dir):
    return V.verdict_counts(compared_facts(spark, sf_dir))


@add(f"with {FACTS_SQL} select brand, count(*) filter (where result = 'mismatch') as mismatch, count(*) filter (where result = 'unknown') as unknown, count(*) filter (where result = 'missing') as missing, count(*) filter (where result = 'match') as match from compared group by 1")
def per_doc_matrix(spark, sf_dir):
    return V.verdict_matrix(compared_facts(spark, sf_dir), "brand")


_GATE = f"""{FACTS_SQL}, gate as (select *, case when target_id is null then ['code_missing'] else list_filter([case when code_result = 'mismatch' then 'code_mismatch' end, case when code_result is null then 'code_unknown' end, case when ref_id % 7 = 0 then 'low_confidence' end, case when coverage < 1 then 'partial_attribute_coverage' end, case when ref_id % 11 = 0 then 'duplicate_entity_facts' end], lambda x: x is not null) end as triggers from compared)"""


def gated(spark, sf_dir):
    c = compared_facts(spark, sf_dir)
    candidates = F.when(F.col("target").isNull(), 0).when(F.col("fact_id") % 11 == 0, 2).otherwise(1)
    return V.gate_triggers(c, F.col("fact_id") % 7 == 0, candidates, F.col("target.evidence_text"))


@add(f"with {_GATE} select ref_id, array_to_string(triggers, ',') as triggers from gate")
def gate_triggers(spark, sf_dir):
    return gated(spark, sf_dir).select(F.col("fact_id").alias("ref_id"), F.array_join("triggers", ",").alias("triggers"))


@add(f"""with {_GATE} select count(*) as total, round(avg(case when len(triggers) = 0 then 1.0 else 0.0 end), 4) as fast_path_rate, round(1 - avg(case when len(triggers) = 0 then 1.0 else 0.0 end), 4) as secondary_review_rate,
    round(coalesce(count(*) filter (where code_result = 'match' and len(triggers) > 0) / nullif(count(*) filter (where code_result = 'match'), 0)::double, 0.0), 4) as unsafe_match_rate, count(*) filter (where len(triggers) > 0 and code_result is not null and code_result <> 'missing') as enforce_new, round(avg(case when len(triggers) > 0 and code_result is not null and code_result <> 'missing' then 1.0 else 0.0 end), 4) as enforce_new_rate, round(coalesce(avg(coverage) filter (where coalesce(code_result, '') <> 'missing'), 0.0), 4) as mean_attribute_coverage from gate""")
def gate_stats(spark, sf_dir):
    return V.gate_stats(gated(spark, sf_dir))


@add(f"with {_GATE} select reason, count(*) as n from (select unnest(triggers) as reason from gate) group by 1")
def gate_reasons(spark, sf_dir):
    return V.trigger_counts(gated(spark, sf_dir))


_PLACE = "case result when 'mismatch' then 0 when 'unknown' then 1 when 'missing' then 2 else 3 end"


@add(f"with {FACTS_SQL} select ref_id, result, {_PLACE} as place, row_number() over (order by {_PLACE}, brand, entity_name, ref_id) as line from compared")
def report_order(spark, sf_dir):
    """Every line of the report: worst results first, then by target and name."""
    compared = compared_facts(spark, sf_dir).select(F.col("fact_id").alias("ref_id"), "result", V.report_order(F.col("result")).alias("place"), "brand", "entity_name")
    return number_rows(compared, ["place", "brand", "entity_name", "ref_id"], "line").select("ref_id", "result", "place", "line")


_BOUNDS = "b as (select fact_id, lo, mid, hi, case when fact_id % 3 = 0 then hi else lo end as low, case when fact_id % 3 = 0 then lo else hi end as high from tgt0)"


@add(f"with {FACTS_SQL}, {_BOUNDS} select fact_id, 'quant_bounds' as check_name, 'error' as severity, array_to_string(list_filter([case when low > high then 'lower>upper' end, case when low > mid then 'lower>target' end, case when mid > high then 'target>upper' end], lambda x: x is not null), ',') as reason from b where low > high or low > mid or mid > high")
def quant_bounds(spark, sf_dir):
    a = F.col("attributes")
    value = lambda k: F.try_element_at(a, F.lit(k))["value"].cast("double")
    swap = F.col("fact_id") % 3 == 0
    mid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fact_id")).agg(F.round(F.avg("l_quantity"), 0).alias("mid"))
    facts = target_facts(spark, sf_dir).join(mid, "fact_id")
    turned = V.attributes(lower_limit=(F.when(swap, value("upper_limit")).otherwise(value("lower_limit")), ""), target_value=(F.col("mid"), ""), upper_limit=(F.when(swap, value("lower_limit")).otherwise(value("upper_limit")), ""))
    return V.check_bounds(facts.withColumn("attributes", turned))


@add("""select p_partkey as fact_id, 'unit_missing' as check_name, 'warn' as severity, 'size' as reason from part where p_partkey % 2 = 0
    union all select p_partkey, 'no_attributes', 'warn', '' from part where p_partkey % 5 = 1 and p_partkey % 2 = 1""")
def unit_missing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even, none = F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 5 == 1) & (F.col("p_partkey") % 2 == 1)
    bare = V.attributes(size=(F.col("p_size"), ""), colour=(F.col("p_brand"), ""))
    units = V.attributes(size=(F.col("p_size"), "mA"))
    return V.check_units(p.select(F.col("p_partkey").alias("fact_id"), F.when(even, bare).when(none, F.map_from_arrays(F.array(), F.array()).cast("map<string,struct<value:string,unit:string>>")).otherwise(units).alias("attributes")))


@add("""with n as (select doc_id, list_distinct(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')) as v from documents) select doc_id as fact_id, 'numeric_coverage' as check_name, 'warn' as severity, len(v)::varchar as reason from n where len(v) >= 4""")
def numeric_coverage(spark, sf_dir):
    none = F.map_from_arrays(F.array(F.lit("source")), F.array(F.struct(F.lit("text").alias("value"), F.lit("").alias("unit"))))
    return V.check_numeric_coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("evidence_text"), none.alias("attributes")))


@add("select l_orderkey as fact_id, 'source' as check_name, 'error' as severity, l_partkey::varchar as reason from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def source_valid(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("row"))
    locators = table(spark, sf_dir, "part").where("p_size < 40").select(F.lit("d").alias("doc"), F.col("p_partkey").alias("locator"))
    return V.check_sources(facts, locators, "row")


@add(f"""with {FACTS_SQL}, {_BOUNDS}, checks as (select fact_id, 'quant_bounds' as check_name, 'error' as severity from b where low > high or low > mid or mid > high
    union all select doc_id, 'numeric_coverage', 'warn' from documents where len(list_distinct(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'))) >= 4)
    select check_name, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warn') as warnings, count(distinct case when severity = 'error' then fact_id end) as low_confidence from checks group by 1""")
def checks_summary(spark, sf_dir):
    return V.validation_summary(quant_bounds(spark, sf_dir).unionByName(numeric_coverage(spark, sf_dir)))


@add(f"with {FACTS_SQL} select brand, case when bool_or(result = 'mismatch') then 'mismatch' when bool_or(result = 'missing') then 'missing' when bool_or(result = 'match') then 'match' else 'unknown' end as result from compared group by 1")
def collapse_verdicts(spark, sf_dir):
    return V.collapse_verdicts(compared_facts(spark, sf_dir), "brand", ("mismatch", "missing", "match", "unknown"))


@add("""with o as (select o_custkey as k, arg_max(o_orderstatus, o_orderkey) as old_result from orders where o_orderdate < timestamp '1997-01-01' group by 1), n as (select o_custkey as k, arg_max(o_orderstatus, o_orderkey) as new_result from orders group by 1)
    select coalesce(o.k, n.k) as o_custkey, old_result, new_result from o full join n on o.k = n.k where old_result is distinct from new_result""")
def run_diff(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("result"), F.col("o_orderkey").alias("pos"), "o_orderdate")
    return V.diff_runs(runs.where("o_orderdate < timestamp '1997-01-01'"), runs, ["o_custkey"])


_CASE = f"""{FACTS_SQL}, cases as (select ref_id, ref_id % 13 = 0 as a, ref_id % 13 = 1 as b, ref_id % 13 = 2 as c, case when ref_id % 5 = 0 then 1 else 0 end as n_blockers, case when ref_id % 4 = 0 then 0 else 2 end as n_cited, case when ref_id % 6 = 0 then null else ref_id % 3 end as n_candidates, (ref_id % 100) / 100.0 as best from compared where result <> 'match'),
    caused as (select ref_id, case when a then 'f5_llm' when b then 'evidence_gate' when c then 'llm_undecided' when n_blockers > 0 then 'blocked' when n_cited = 0 then 'extraction' when n_candidates is null then 'unresolved' else 'recall' end as cause, n_candidates, best from cases)"""


def _caused(spark, sf_dir):
    k = F.col("fact_id")
    case = compared_facts(spark, sf_dir).where("result <> 'match'").select(
        k.alias("ref_id"), (k % 13 == 0).alias("decided_by_model"), (k % 13 == 1).alias("edge_rejected"), (k % 13 == 2).alias("edge_unknown"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("n_blockers"), F.when(k % 4 == 0, 0).otherwise(2).alias("n_cited_blocks"), F.when(k % 6 != 0, k % 3).alias("n_candidates"), F.when(k % 7 == 0, 1).otherwise(0).alias("n_kept"), ((k % 100) / 100.0).alias("best_score"), F.lit(0.3).alias("floor"),
    )
    return D.missing_cause(case)


@add(f"with {_CASE} select ref_id, cause, case when cause <> 'recall' then '' when n_candidates = 0 then 'empty' when ref_id % 7 = 0 then 'no_edge' when best < 0.3 then 'min_score' else 'top_k' end as subcause from caused")
def missing_cause(spark, sf_dir):
    return _caused(spark, sf_dir).select("ref_id", "cause", "subcause")


@add(f"with {_CASE} select cause, count(*) as n from caused group by 1")
def cause_counts(spark, sf_dir):
    return _caused(spark, sf_dir).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@add("with f as (select o_custkey, arg_min(o_orderstatus, o_orderkey) as result from orders group by 1) select c_custkey, c_mktsegment as expected, result from customer join f on c_custkey = o_custkey")
def golden_join(spark, sf_dir):
    golden = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("expected"))
    comparisons = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("result"), "o_orderkey")
    return D.first_match_join(golden, comparisons, "c_custkey", "o_orderkey")


@add("select p_partkey, 'fact-' || p_brand || '-' || row_number() over (partition by p_brand order by p_partkey) as fact_id, substring(sha1(p_name || chr(0) || p_brand || chr(0)), 1, 12) as fingerprint from part")
def fact_numbers(spark, sf_dir):
    from ..functions.text import fingerprint

    return V.number_facts(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", "fact_id", fingerprint("p_name", "p_brand").alias("fingerprint"))


@add(f"with {FACTS_SQL} select coalesce(brand, 'all') as brand, result, count(*) as n from compared group by grouping sets ((brand, result), (result))")
def verdict_rollup(spark, sf_dir):
    """Counts of results per brand and over all."""
    c = compared_facts(spark, sf_dir).groupingSets([[F.col("brand"), F.col("result")], [F.col("result")]], F.col("brand"), F.col("result"))
    return c.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("brand", F.lit("all")).alias("brand"), "result", "n")


@add(f"with {FACTS_SQL} select ref_id, case when result = 'match' then 'linked' when code_result is null and target_id is not null then 'undecided' when result = 'missing' then 'absent' else 'rejected' end as tone from compared")
def edge_tones(spark, sf_dir):
    tone = F.when(F.col("result") == "match", "linked").when(F.col("code_result").isNull() & F.col("target").isNotNull(), "undecided").when(F.col("result") == "missing", "absent").otherwise("rejected")
    return compared_facts(spark, sf_dir).select(F.col("fact_id").alias("ref_id"), tone.alias("tone"))
