"""Candidates of reference facts in each target document, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name
from .containment import contained
from .ordering import shuffled, written

#: Results of a comparison.
RESULTS = ("match", "mismatch", "missing", "unknown")


def candidates(reference: DataFrame, targets: DataFrame, ranked: DataFrame | None = None, keep: int = 3) -> DataFrame:
    """(ref_id, target_doc, target_id, score, method, place, needs_review) of facts (doc, fact_id, entity_name, pos).

    In each target document the first fact of equal normalised name is the only candidate, with score 1; where there is none,
    the best ``keep`` of ``ranked`` (ref_id, target_doc, target_id, score, rank, needs_review) are.
    """
    first = targets.select(F.col("doc").alias("target_doc"), F.col("fact_id").alias("target_id"), norm_name("entity_name").alias("name"), "pos").where("name <> ''")
    first = first.groupBy("target_doc", "name").agg(F.min_by("target_id", "pos").alias("target_id"))
    named = reference.select(F.col("fact_id").alias("ref_id"), norm_name("entity_name").alias("name"))
    named = shuffled(named).join(first, "name")
    exact = named.select("ref_id", "target_doc", "target_id", F.lit(1.0).alias("score"), F.lit("name").alias("method"), F.lit(1).alias("place"), F.lit(False).alias("needs_review"))
    if ranked is None:
        return exact
    # read twice below
    exact = written(exact, "named")
    rest = ranked.join(shuffled(exact.select("ref_id", "target_doc")), ["ref_id", "target_doc"], "left_anti").where(F.col("rank") <= keep)
    return exact.unionByName(rest.select("ref_id", "target_doc", "target_id", F.col("score").cast("double").alias("score"), F.lit("ranked").alias("method"), F.col("rank").cast("int").alias("place"), "needs_review"))


#: Target documents of one comparison at most; a run with more is several comparisons.
MOST_DOCUMENTS = 10_000


def document_names(targets: DataFrame) -> list[str]:
    """The target documents of a comparison, in order: a list of files that somebody compares, checked to be short."""
    found = [r["doc"] for r in targets.select("doc").where("doc is not null").distinct().limit(MOST_DOCUMENTS + 1).collect()]
    if len(found) > MOST_DOCUMENTS:
        raise ValueError(f"more than {MOST_DOCUMENTS} target documents in one comparison: compare them in parts")
    return sorted(found)


def attach(reference: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """Each reference fact once per target document with its best candidate as ``target`` (null if none), ``n_candidates`` and
    ``needs_review``."""
    # every reference fact is compared with every target document: the result has that many rows by definition
    slots = reference.select("*", F.explode(F.array(*map(F.lit, document_names(targets))).cast("array<string>")).alias("target_doc"))
    per = found.groupBy(F.col("ref_id").alias("fact_id"), "target_doc").agg(F.count(F.lit(1)).cast("int").alias("n_candidates"), F.min_by(F.struct("target_id", "needs_review"), F.struct("place", "target_id")).alias("_best"))
    facts = targets.select(F.col("doc").alias("target_doc"), F.col("fact_id").alias("_target_id"), F.struct(*targets.columns).alias("target"))
    joined = slots.join(shuffled(per), ["fact_id", "target_doc"], "left").withColumn("_target_id", F.col("_best.target_id")).join(shuffled(facts), ["target_doc", "_target_id"], "left")
    return joined.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "needs_review": F.coalesce("_best.needs_review", F.lit(False))}).drop("_best", "_target_id")


def edge_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) with the relation of the first edge (left_id, right_id, relation, pos) between them, whichever way it points."""
    ends = lambda x, y: (F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    first = edges.select(*ends("left_id", "right_id"), "relation", "pos").groupBy("lo", "hi").agg(F.min_by("relation", "pos").alias("relation"))
    return pairs.select("*", *ends("a", "b")).join(first, ["lo", "hi"], "left").drop("lo", "hi")


def blocked_by(reference: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_id, target_doc, n_blockers, confirmed, axes): the differs_by edges (left_doc, left_id, right_doc, right_id, relation, axis,
    promoted) that touch a reference fact, by the other end's document; a promoted edge confirms, axes are sorted and distinct."""
    apart = edges.where("relation = 'differs_by'")
    touching = apart.select(F.explode(F.array(F.struct(F.col("left_id").alias("ref_id"), F.col("right_doc").alias("target_doc")), F.struct(F.col("right_id").alias("ref_id"), F.col("left_doc").alias("target_doc")))).alias("e"), "axis", "promoted")
    per = touching.select("e.ref_id", "e.target_doc", "axis", "promoted").join(reference.select(F.col("fact_id").alias("ref_id")), "ref_id", "left_semi")
    return per.groupBy("ref_id", "target_doc").agg(F.count(F.lit(1)).alias("n_blockers"), F.bool_or("promoted").alias("confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("axis") != "", F.col("axis")))), ", ").alias("axes"))


def shortfall(compared: DataFrame) -> DataFrame:
    """Comparisons (candidate_ids, finding_ids) of two or more candidates whose findings are not the same, with the ids that lack
    one and how many findings name no candidate."""
    lost = F.array_sort(F.array_except("candidate_ids", "finding_ids"))
    unknown = F.size(F.array_except("finding_ids", "candidate_ids"))
    return compared.where((F.size("candidate_ids") >= 2) & ((F.size(lost) > 0) | (unknown > 0))).withColumn("lost", lost).withColumn("unknown", unknown)


def record_findings(fields: DataFrame, findings: DataFrame, record: str, field: str) -> DataFrame:
    """Every field of a record with its last finding (pos, result); a field without one is not found."""
    last = findings.groupBy(record, field).agg(F.max_by("result", "pos").alias("result"))
    return fields.join(last, [record, field], "left").withColumn("found", F.col("result").isNotNull()).withColumn("result", F.coalesce("result", F.lit("not_found")))


def record_result(found: DataFrame, record: str) -> DataFrame:
    """A record's result without a model's own: not found if none of its fields is, else partial, or match if all agree."""
    agree = F.bool_and(F.col("result") == "match")
    return found.groupBy(record).agg(F.when(~F.bool_or("found"), "not_found").when(agree, "match").otherwise("partial").alias("result"))


def score_engine(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """Labelled names (golden_id, doc, entity_name, expected) with an engine's result: that of the equal normalised name in the
    document, or else of the first answer (pos) whose name holds it or lies in it.

    Names that hold each other are found by one automaton either way, not by pairing all names of a document.
    """
    g = golden.withColumn("_g", norm_name("entity_name"))
    a = answers.select("doc", norm_name("entity_name").alias("_a"), "result", "pos").where("_a <> ''")
    equal = written(g.join(a.groupBy("doc", F.col("_a").alias("_g")).agg(F.min_by("result", "pos").alias("exact")), ["doc", "_g"], "left"), "golden")
    rest = equal.where("exact is null and _g <> ''").select("golden_id", "doc", "_g")
    first = a.groupBy("doc", "_a").agg(F.min(F.struct("pos", "result")).alias("answer"))
    longer = contained(first.select("doc", "_a", "answer"), F.col("_a"), ["doc", "answer"], rest.select(F.col("_g").alias("name"))).join(rest.withColumnRenamed("_g", "name"), ["doc", "name"]).select("golden_id", "answer")
    shorter = contained(rest, F.col("_g"), ["golden_id", "doc"], first.select(F.col("_a").alias("name"))).join(first.withColumnRenamed("_a", "name"), ["doc", "name"]).select("golden_id", "answer")
    near = longer.unionByName(shorter).groupBy("golden_id").agg(F.min("answer").alias("answer"))
    return equal.join(near, "golden_id", "left").select(*golden.columns, F.coalesce("exact", "answer.result").alias("result"))


def engine_stats(scored: DataFrame) -> DataFrame:
    """One row: hits, misses, unmatched and accuracy over what was matched."""
    hit = F.col("result") == F.col("expected")
    return scored.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("result").isNull()).alias("unmatched"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


def engine_confusion(scored: DataFrame) -> DataFrame:
    """(expected, result, n) of what was matched: all pairs of RESULTS, those that do not occur with 0."""
    cells = F.explode(F.array(*(F.struct(F.lit(e).alias("expected"), F.lit(r).alias("result")) for e in RESULTS for r in RESULTS))).alias("c")
    grid = scored.sparkSession.range(1).select(cells).select("c.*")
    found = scored.where(F.col("result").isNotNull()).groupBy("expected", "result").agg(F.count(F.lit(1)).alias("_n"))
    # 16 rows
    return F.broadcast(grid).join(found, ["expected", "result"], "left").select("expected", "result", F.coalesce("_n", F.lit(0)).alias("n"))


def rank_changes(before: DataFrame, after: DataFrame, key: str, k: int, missing: int = 999) -> DataFrame:
    """Keys whose rank differs between two modes (an absent one counts ``missing``), with what that does to the first k."""
    joined = before.select(key, F.col("rank").alias("old_rank")).join(after.select(key, F.col("rank").alias("new_rank")), key, "full")
    old, new = F.coalesce("old_rank", F.lit(missing)), F.coalesce("new_rank", F.lit(missing))
    move = F.when((old > k) & (new <= k), "enters").when((old <= k) & (new > k), "leaves").when(new < old, "better").otherwise("worse")
    return joined.where(old != new).select(key, old.cast("long").alias("old_rank"), new.cast("long").alias("new_rank"), move.alias("change"))


def newest(rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The newest row of each key; of equal ones the last by ``ties``, and then by all columns."""
    last = F.max_by(F.struct(*rows.columns), F.struct(order, *ties, *(c for c in rows.columns if c not in (key, order, *ties))))
    return rows.groupBy(key).agg(last.alias("_last")).select("_last.*")
