"""Facts: exact name matching, attribute comparison, verdicts, the acceptance gate, validation and coverage.

A fact is a row (doc, fact_id, entity_name, attributes, evidence_text, pos) whose attributes are a map of name to
struct<value, unit>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import as_number, compare_attribute
from ..functions.text import collapse, is_blank, norm_name, once, tokens
from .ordering import number_rows

RESULTS = ("mismatch", "unknown", "missing", "match")
# Reasons of the gate in reporting order.
REASONS = ("code_missing", "code_mismatch", "code_unknown", "low_confidence", "partial_attribute_coverage", "duplicate_entity_facts", "invalid_evidence")
BOUNDS = ("lower_limit", "upper_limit")


def attributes(**named: tuple[Column, str]) -> Column:
    """A map of attributes from (value column, unit); nulls are left out."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.struct(v.cast("string").alias("value"), F.lit(u).alias("unit")).alias("value")) for n, (v, u) in named.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"]["value"].isNotNull()))


def match_by_name(reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Each reference fact with the first target fact (by pos) of equal normalised name, or with none."""
    first = targets.withColumn("_name", norm_name("entity_name")).where("_name <> ''")
    first = first.groupBy("_name").agg(F.min_by(F.struct(*targets.columns), "pos").alias("target"))
    return reference.withColumn("_name", norm_name("entity_name")).join(first, "_name", "left").drop("_name")


def attribute_states(ref: Column, target: Column) -> Column:
    """Array of (key, same) in the reference's key order: same is true, false or null; two single attributes of different
    names are compared with each other unless they are opposite bounds."""
    none = F.array().cast("array<struct<key:string,same:boolean>>")
    of = lambda k, p: F.struct(k.alias("key"), compare_attribute(p["a"]["value"], p["a"]["unit"], p["b"]["value"], p["b"]["unit"]).alias("same"))
    both = lambda k, a, b: once(F.struct(a.alias("a"), b.alias("b")), lambda p: of(k, p))
    k1, k2 = F.get(F.map_keys(ref), F.lit(0)), F.get(F.map_keys(target), F.lit(0))
    single = (F.size(ref) == 1) & (F.size(target) == 1) & ~(k1.isin(*BOUNDS) & k2.isin(*BOUNDS) & (k1 != k2))
    alone = F.when(single, F.array(both(k1, F.get(F.map_values(ref), F.lit(0)), F.get(F.map_values(target), F.lit(0))))).otherwise(none)
    by_key = lambda shared: F.transform(shared, lambda k: both(k, F.try_element_at(ref, k), F.try_element_at(target, k)))
    return once(F.filter(F.map_keys(ref), lambda k: F.map_contains_key(target, k)), lambda shared: F.when(F.size(shared) > 0, by_key(shared)).otherwise(alone))


def code_verdict(states: Column) -> Column:
    """match, mismatch, or null if any attribute is undecided or none is shared."""
    undecided = lambda all_: (F.size(all_) == 0) | F.exists(all_, lambda s: s["same"].isNull())
    return once(states, lambda all_: F.when(undecided(all_), F.lit(None).cast("string")).when(F.forall(all_, lambda s: s["same"]), "match").otherwise("mismatch"))


def attribute_coverage(ref: Column, target: Column) -> Column:
    """Share of the reference's attributes that the target has; 0 without a target, 1 for two single attributes."""
    covered = F.size(F.filter(F.map_keys(ref), lambda k: F.map_contains_key(target, k)))
    return F.when(target.isNull(), 0.0).when(F.size(ref) == 0, 1.0).when((F.size(ref) == 1) & (F.size(target) == 1), 1.0).otherwise(covered / F.size(ref))


def compare(matched: DataFrame) -> DataFrame:
    """Verdicts of matched facts (attributes, target.attributes): code result, mismatching keys, coverage, final result.

    Without a model an undecided comparison ends as unknown and one without a target as missing.
    """
    target = F.col("target.attributes")
    states = F.when(F.col("target").isNotNull(), attribute_states(F.col("attributes"), target))
    code = F.when(F.col("target").isNull(), "missing").otherwise(code_verdict(F.col("_states")))
    # the code's result is a column before anything names it, so a row is compared once
    out = matched.withColumn("_states", states).withColumn("code_result", code)
    wrong = F.transform(F.filter("_states", lambda s: s["same"] == F.lit(False)), lambda s: s["key"])
    return out.withColumns({"mismatch_attributes": F.when(F.col("code_result") == "mismatch", F.array_join(wrong, ",")).otherwise(""), "coverage": attribute_coverage(F.col("attributes"), target), "result": F.coalesce("code_result", F.lit("unknown"))}).drop("_states")


def gate_triggers(compared: DataFrame, uncertain: Column, candidates: Column, evidence: Column) -> DataFrame:
    """Reasons to review, in fixed order; without a candidate the only one is code_missing."""
    reasons = F.array(
        F.when(F.col("code_result") == "mismatch", "code_mismatch"),
        F.when(F.col("code_result").isNull(), "code_unknown"),
        F.when(uncertain, "low_confidence"),
        F.when(F.col("coverage") < 1.0, "partial_attribute_coverage"),
        F.when(candidates > 1, "duplicate_entity_facts"),
        F.when(is_blank(evidence), "invalid_evidence"),
    )
    return compared.withColumn("triggers", F.when(candidates == 0, F.array(F.lit("code_missing"))).otherwise(F.array_compact(reasons)))


def route(attached: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """Final routing without a model: the code's verdict stands if it is certain, else the result is unknown.

    ``attached`` has n_candidates and needs_review beside ``compare``'s columns.  A comparison is uncertain if its match needs a
    review or either fact is of ``low`` confidence (doc, fact_id); with several candidates the code never decides.  Adds
    ``uncertain``, ``result``, ``decided_by`` and the gate's ``triggers``.
    """
    rows = attached
    if low is None:
        rows = rows.withColumn("_low", F.lit(False))
    else:
        own = low.select("doc", "fact_id", F.lit(True).alias("_own")).distinct()
        other = low.select(F.col("doc").alias("target_doc"), F.col("fact_id").alias("_tid"), F.lit(True).alias("_other")).distinct()
        rows = rows.withColumn("_tid", F.col("target.fact_id")).join(own, ["doc", "fact_id"], "left").join(other, ["target_doc", "_tid"], "left")
        rows = rows.withColumn("_low", F.coalesce("_own", F.lit(False)) | F.coalesce("_other", F.lit(False))).drop("_own", "_other", "_tid")
    rows = rows.withColumn("uncertain", F.col("needs_review") | F.col("_low")).drop("_low")
    certain = F.col("code_result").isNotNull() & ((F.col("code_result") == "missing") | (~F.col("uncertain") & (F.col("n_candidates") == 1)))
    rows = rows.withColumn("result", F.when(certain, F.col("code_result")).otherwise("unknown")).withColumn("decided_by", F.when(certain, "code").otherwise(""))
    return gate_triggers(rows, F.col("uncertain"), F.col("n_candidates"), F.col("target.evidence_text"))


def gate_stats(gated: DataFrame) -> DataFrame:
    """One row of rates over gated comparisons (rounded to 4 places); empty input gives no row."""
    safe = F.size("triggers") == 0
    code_match = F.col("code_result") == "match"
    n = F.count(F.lit(1))
    matches = F.count_if(code_match)
    routed = ~safe & F.col("code_result").isNotNull() & (F.col("code_result") != "missing")
    return gated.agg(
        n.alias("total"),
        F.round(F.count_if(safe) / n, 4).alias("fast_path_rate"),
        F.round(1 - F.count_if(safe) / n, 4).alias("secondary_review_rate"),
        F.round(F.when(matches > 0, F.count_if(code_match & ~safe) / matches).otherwise(0.0), 4).alias("unsafe_match_rate"),
        F.count_if(routed).alias("enforce_new"),
        F.round(F.count_if(routed) / n, 4).alias("enforce_new_rate"),
        F.round(F.coalesce(F.avg(F.when(F.coalesce(F.col("code_result"), F.lit("")) != "missing", F.col("coverage"))), F.lit(0.0)), 4).alias("mean_attribute_coverage"),
    ).where("total > 0")


def trigger_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("triggers").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def verdict_counts(compared: DataFrame) -> DataFrame:
    """Every result with its count, zeros included."""
    dim = compared.sparkSession.createDataFrame([(r,) for r in RESULTS], "result string")
    counts = compared.groupBy("result").agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(dim).join(counts, "result", "left").select("result", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def verdict_matrix(compared: DataFrame, doc: str) -> DataFrame:
    return compared.groupBy(doc).pivot("result", list(RESULTS)).agg(F.count(F.lit(1))).na.fill(0)


def report_order(result: Column) -> Column:
    return F.when(result == "mismatch", 0).when(result == "unknown", 1).when(result == "missing", 2).otherwise(3)


def check_bounds(facts: DataFrame) -> DataFrame:
    """Errors where lower <= target <= upper does not hold: (fact_id, check_name, severity, reason)."""
    value = lambda k: as_number(F.try_element_at("attributes", F.lit(k))["value"])
    low, mid, high = value("lower_limit"), value("target_value"), value("upper_limit")
    bad = F.array_compact(F.array(F.when(low > high, "lower>upper"), F.when(low > mid, "lower>target"), F.when(mid > high, "target>upper")))
    return facts.select("fact_id", F.lit("quant_bounds").alias("check_name"), F.lit("error").alias("severity"), F.array_join(bad, ",").alias("reason")).where("reason <> ''")


def check_units(facts: DataFrame) -> DataFrame:
    """Warnings for numeric attributes without a unit, and for facts without attributes."""
    bare = F.map_keys(F.map_filter("attributes", lambda k, v: as_number(v["value"]).isNotNull() & (F.coalesce(v["unit"], F.lit("")) == "")))
    missing = facts.select("fact_id", F.lit("unit_missing").alias("check_name"), F.lit("warn").alias("severity"), F.array_join(F.array_sort(bare), ",").alias("reason")).where("reason <> ''")
    none = facts.where(F.size("attributes") == 0).select("fact_id", F.lit("no_attributes").alias("check_name"), F.lit("warn").alias("severity"), F.lit("").alias("reason"))
    return missing.unionByName(none)


def check_numeric_coverage(facts: DataFrame, least: int = 4) -> DataFrame:
    """Warnings where the evidence holds ``least`` or more distinct numbers and no attribute's value holds any."""
    numbers = F.array_distinct(F.regexp_extract_all("evidence_text", F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    none = ~F.exists(F.map_values("attributes"), lambda v: F.coalesce(v["value"], F.lit("")).rlike("[0-9]"))
    return facts.where((F.size(numbers) >= least) & none).select("fact_id", F.lit("numeric_coverage").alias("check_name"), F.lit("warn").alias("severity"), F.size(numbers).cast("string").alias("reason"))


def evidence_coverage(claim: Column, source: Column) -> Column:
    """Share of the claim's distinct tokens that the source has; 0 for a claim without tokens."""
    mine = F.array_distinct(tokens(claim))
    return F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, tokens(source))) / F.size(mine))


def check_sources(facts: DataFrame, locators: DataFrame, source: str) -> DataFrame:
    """Errors for facts whose source is no locator of their document."""
    lost = facts.join(locators.select("doc", F.col("locator").alias(source)).distinct(), ["doc", source], "left_anti")
    return lost.select("fact_id", F.lit("source").alias("check_name"), F.lit("error").alias("severity"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("reason"))


def validation_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_name").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.count_distinct(F.when((F.col("severity") == "error") & (F.col("fact_id").cast("string") != ""), F.col("fact_id"))).alias("low_confidence"))


def facts_by_block(blocks: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc, block_id, n_facts): every block with the facts that cite it; 0 for uncited ones."""
    counts = cited.groupBy("doc", "block_id").agg(F.count_distinct("fact_id").alias("_n"))
    return blocks.join(counts, ["doc", "block_id"], "left").select("doc", "block_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_facts"))


def line_coverage(lines: DataFrame, cited: DataFrame, least: int = 3) -> DataFrame:
    """(doc, block_id, line_id, covered): whether the line lies in the evidence of a fact citing its block, or the other way round.

    A block's distinct lines meet its distinct evidence, however often either is repeated.
    """
    place = ["doc", "block_id"]
    own = lines.select(*place, "line_id", collapse("raw_text").alias("line"))
    proof = cited.select(*place, collapse("evidence_text").alias("evidence")).where(F.length("evidence") >= least).distinct()
    met = own.where(F.length("line") >= least).select(*place, "line").distinct().join(proof, place)
    found = met.where(F.contains("evidence", F.col("line")) | F.contains("line", F.col("evidence"))).select(*place, "line").distinct().withColumn("covered", F.lit(True))
    return own.join(found, [*place, "line"], "left").groupBy(*place, "line_id").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"))


def duplicate_roles(columns: DataFrame, exclusive: tuple[str, ...]) -> DataFrame:
    """Exclusive roles that more than one column of a table claims, with these columns."""
    rows = columns.where(F.col("role").isin(*exclusive)).groupBy("doc", "role").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))
    return rows.where("n > 1")


def collapse_verdicts(compared: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One result of many per key: the first of ``order`` that occurs."""
    place = F.array_position(F.array(*(F.lit(r) for r in order)), F.col("result"))
    return compared.groupBy(key).agg(F.min_by("result", F.when(place > 0, place)).alias("result"))


def diff_runs(old: DataFrame, new: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Changed results between two runs (a later duplicate of a key counts)."""
    last = lambda df, name: df.groupBy(*key).agg(F.max_by("result", order).alias(name))
    joined = last(old, "old_result").join(last(new, "new_result"), key, "full")
    return joined.where(~F.col("old_result").eqNullSafe(F.col("new_result")))


def number_facts(facts: DataFrame, kind: str, order: str) -> DataFrame:
    """Ids ``fact-<kind>-<n>`` in order, from 1 in each kind; a kind may hold any number of facts."""
    numbered = number_rows(facts, [order], "_n", [kind])
    return numbered.withColumn("fact_id", F.concat(F.lit("fact-"), F.col(kind), F.lit("-"), F.col("_n").cast("string"))).drop("_n")


def compare_stats(compared: DataFrame) -> DataFrame:
    """One row: comparisons, how many a model decided, had several candidates, or went against the code's verdict."""
    against = F.col("code_result").isNotNull() & (F.col("result") != F.col("code_result"))
    return compared.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decided_by") == "model").alias("by_model"), F.count_if(F.col("n_candidates") > 1).alias("several"), F.count_if(against).alias("overridden"))


def extraction_stats(rows: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """Per key: rows (drop_reason, sample) seen, kept, and dropped, with the first samples of what was dropped."""
    lost = F.coalesce(F.col("drop_reason") != "", F.lit(False))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.count_if(~lost).alias("kept"), F.count_if(lost).alias("dropped"))
    # distinct drops are counted before they meet their key, and each task passes on only its first ones
    distinct = rows.where(lost).select(key, F.concat_ws(": ", "drop_reason", "sample").alias("_s")).distinct()
    first = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_s"))).where(F.col("_n") <= samples)
    shown = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_s")), "; ").alias("samples"))
    return counts.join(shown, key, "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def coverage_summary(blocks: DataFrame, key: str) -> DataFrame:
    """Per document: blocks, how many facts cite, and the share; from ``facts_by_block``."""
    return blocks.groupBy(key).agg(F.count(F.lit(1)).alias("blocks_in"), F.count_if(F.col("n_facts") > 0).alias("blocks_cited"), F.round(F.avg((F.col("n_facts") > 0).cast("double")), 6).alias("share"))


def fact_type(attributes: Column) -> Column:
    """quantitative if an attribute is a number, qualitative if there is any, else descriptive."""
    numeric = F.exists(F.map_values(attributes), lambda v: as_number(v["value"]).isNotNull())
    return F.when(numeric, "quantitative").when(F.size(attributes) > 0, "qualitative").otherwise("descriptive")
