"""Why a comparison ended as missing: the first cause that applies, with the steps that led to it and the artifacts that show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .ordering import shuffled

# Causes in the order in which they are looked for, and how sure a trace is.
CAUSES = ("f5_llm", "evidence_gate", "llm_undecided", "blocked", "extraction", "recall", "unresolved")
CONFIRMED, INFERRED, UNRESOLVED = "confirmed", "inferred", "unresolved"
#: Ranked candidates that a trace shows.
SHOWN = 8


def undecided_kind(reason: Column) -> Column:
    """Why a pair was not decided: its budget ran out, nobody was asked, or no answer named it."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(F.contains(said, F.lit("budget")), "budget").when(F.contains(said, F.lit("without a model")), "disabled").when(F.contains(said, F.lit("no answer")), "absent").otherwise("")


def _step(stage: str, who: str | Column, ok: bool, note: Column | str = "") -> Column:
    return F.struct(F.lit(stage).alias("stage"), (who if isinstance(who, Column) else F.lit(who)).alias("who"), F.lit(ok).alias("ok"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))


def trace_missing(verdicts: DataFrame, edges: DataFrame, ranked: DataFrame | None, cited: DataFrame, mentioned: DataFrame | None = None) -> DataFrame:
    """A trace of every missing comparison: (fact_id, target_doc, entity_name, cause, subcause, confidence, trail, edges, ranked).

    ``verdicts`` (fact_id, target_doc, entity_name, result, decided_by); ``edges`` of the graph (ref_id, target_doc, target_id, relation,
    axis, decided_by, rejected_by, promoted, reason, score, edge_no of any type with an order); ``ranked`` (ref_id, target_doc, target_id, score, rank, cut_by,
    empty where kept) or none if rankings were not saved; ``cited`` (doc, n_cited) the facts' blocks of each document; ``mentioned`` (doc,
    entity_name) names that uncited blocks hold.

    All missing rows are traced at once: each artifact is summed up per slot and joined.  What was tried with this very partner goes
    before what blocked it, and a document without any fact before a search that found none.
    """
    slot = ["fact_id", "target_doc"]
    missing = verdicts.where("result = 'missing'").select(*slot, "entity_name", "decided_by")
    e = edges.withColumnRenamed("ref_id", "fact_id")
    unknown, refused, apart = F.col("relation") == "unknown", ~is_blank("rejected_by"), F.col("relation") == "differs_by"
    first = lambda when: F.min(F.when(when, F.struct("edge_no", "rejected_by", "reason", "score", "axis", "decided_by")))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") != "same_as", F.struct("edge_no", "target_id", "relation", "axis", "rejected_by", "reason")))), lambda x: F.struct(x["target_id"].alias("target_id"), x["relation"].alias("relation"), x["axis"].alias("axis"), x["rejected_by"].alias("rejected_by"), x["reason"].alias("reason")))
    per_edge = e.join(shuffled(missing.select(*slot)), slot, "left_semi").groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n_edges"), first(unknown & refused).alias("refusal"), first(unknown & ~refused).alias("undecided"), F.count_if(apart).alias("n_apart"),
        F.coalesce(first(apart & F.col("promoted")), first(apart)).alias("lead"), F.coalesce(F.bool_or(apart & F.col("promoted")), F.lit(False)).alias("promoted"), shown.alias("edges"),
    )
    rows = missing.join(shuffled(per_edge), slot, "left").join(cited.select(F.col("doc").alias("target_doc"), "n_cited"), "target_doc", "left")
    if ranked is None:
        rows = rows.withColumn("ranked", F.lit(None).cast("array<struct<rank:int,score:double,cut_by:string>>"))
    else:
        one = F.struct(F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.coalesce("cut_by", F.lit("")).alias("cut_by"))
        per = ranked.withColumnRenamed("ref_id", "fact_id").groupBy(*slot).agg(F.array_sort(F.collect_list(one)).alias("ranked"))
        rows = rows.join(shuffled(per), slot, "left")
    if mentioned is None:
        rows = rows.withColumn("said", F.lit(False))
    else:
        names = mentioned.select(F.col("doc").alias("target_doc"), "entity_name", F.lit(True).alias("said")).distinct()
        rows = rows.join(names, ["target_doc", "entity_name"], "left").withColumn("said", F.coalesce("said", F.lit(False)))
    model, top = F.col("decided_by") == "model", F.get("ranked", F.lit(0))
    kept = F.size(F.filter("ranked", lambda r: r["cut_by"] == ""))
    none_cited = F.coalesce("n_cited", F.lit(0)) == 0
    cases = [  # cause, when, subcause, confidence, trail
        ("f5_llm", model, F.lit(""), F.lit(CONFIRMED), [_step("recall", "embed", True), _step("comparison", "model", False, "the judge saw the candidates and named none")]),
        ("evidence_gate", F.col("refusal").isNotNull(), F.col("refusal.rejected_by"), F.lit(CONFIRMED), [_step("recall", "embed", True, F.format_string("%.4f", "refusal.score")), _step("judgement", F.col("refusal.decided_by"), True, "same_as"), _step("gate", "code", False, F.col("refusal.rejected_by")), _step("comparison", "code", False)]),
        ("llm_undecided", F.col("undecided").isNotNull(), undecided_kind(F.col("undecided.reason")), F.lit(CONFIRMED), [_step("recall", "embed", True, F.format_string("%.4f", "undecided.score")), _step("judgement", F.col("undecided.decided_by"), False, F.col("undecided.reason")), _step("comparison", "code", False)]),
        ("blocked", F.col("n_apart") > 0, F.coalesce("lead.axis", F.lit("")), F.when(F.col("promoted"), CONFIRMED).otherwise(INFERRED), [_step("concepts", F.col("lead.decided_by"), False, F.format_string("differs_by %d of %d", "n_apart", "n_edges")), _step("comparison", "code", False)]),
        ("extraction", none_cited | F.col("said"), F.when(none_cited, "no_block").otherwise("mentioned"), F.when(none_cited, CONFIRMED).otherwise(INFERRED), [_step("extraction", "code", False), _step("comparison", "code", False)]),
        ("unresolved", F.col("ranked").isNull(), F.lit(""), F.lit(UNRESOLVED), [_step("recall", "embed", False, "no ranking was saved")]),
        ("recall", F.lit(True), F.when(F.size("ranked") == 0, "empty").when(kept > 0, "no_edge").otherwise(F.coalesce(F.nullif(top["cut_by"], F.lit("")), F.lit("min_score"))), F.when(kept > 0, INFERRED).otherwise(CONFIRMED), [_step("extraction", "code", True), _step("recall", "embed", False, F.format_string("%d of %d kept", kept, F.size("ranked"))), _step("comparison", "code", False)]),
    ]
    found = F
    for cause, when, sub, sure, trail in cases:
        found = found.when(when, F.struct(F.lit(cause).alias("cause"), sub.alias("subcause"), sure.alias("confidence"), F.array(*trail).alias("trail")))
    empty = F.array().cast(rows.schema["edges"].dataType)
    return rows.withColumn("t", found).select(*slot, "entity_name", "t.*", F.coalesce("edges", empty).alias("edges"), F.slice("ranked", 1, SHOWN).alias("ranked"))


def cause_histogram(traces: DataFrame) -> DataFrame:
    """(cause, n) of all causes, zeros included."""
    counts = traces.groupBy("cause").agg(F.count(F.lit(1)).alias("_n"))
    every = traces.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CAUSES))).alias("cause"))
    return F.broadcast(every).join(counts, "cause", "left").select("cause", F.coalesce("_n", F.lit(0)).alias("n"))
