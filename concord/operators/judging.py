"""What becomes of answers that a judge gives, whoever it is: findings, pairs, items; broken or absent answers end as unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RELATION_WORDS, RESULT_WORDS, coerce, collapse, is_blank, table_line, truncate

# Why a call gave no answer, by its status, and results of an item comparison.
FAILURES = {"length": "output_truncated", "budget": "budget_exceeded", "parse": "parse_failure"}
ITEM_WORDS = ("same", "different", "partial", "unknown", "not_found")


def judge_facts(answers: DataFrame, candidates: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Results of judged comparisons ``answers`` (key, status, result), by their findings (key, fact_id, result,
    mismatch_attributes, pos) on ``candidates`` (key, fact_id).

    Findings on other ids are dropped and counted; if none is left of some, the result is unknown.  The target is the first
    mismatch, or else the first finding, and none for a missing one.  Mismatching attributes are distinct in their order.  A status
    other than ok gives unknown with its ``failure_reason``, decided by the code.
    """
    known = candidates.select(key, "fact_id", F.lit(True).alias("_known")).distinct()
    held = findings.join(known, [key, "fact_id"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    own = F.col("_known")
    wrong = F.array_sort(F.collect_list(F.when(own, F.struct("pos", "mismatch_attributes"))))
    per = held.groupBy(key).agg(
        F.count_if(own).alias("n_findings"),
        F.count_if(~own).alias("n_dropped"),
        F.min_by(F.when(own, F.col("fact_id")), F.when(own, F.struct(F.coalesce(F.col("result"), F.lit("")) != "mismatch", "pos"))).alias("target_id"),
        F.array_distinct(F.flatten(F.transform(wrong, lambda w: F.coalesce(w["mismatch_attributes"], F.array().cast("array<string>"))))).alias("wrong"),
    )
    rows = answers.join(per, key, "left").withColumns({"n_findings": F.coalesce("n_findings", F.lit(0)), "n_dropped": F.coalesce("n_dropped", F.lit(0))})
    failure = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))[F.col("status")]
    rows = rows.withColumn("failure_reason", F.coalesce(failure, F.lit("")))
    failed, baseless = F.col("failure_reason") != "", (F.col("n_dropped") > 0) & (F.col("n_findings") == 0)
    rows = rows.withColumn("result", F.when(failed | baseless, "unknown").otherwise(coerce("result", RESULT_WORDS, "unknown")))
    lost = failed | baseless
    return rows.withColumns({
        "decided_by": F.when(failed, "code").otherwise("model"),
        "target_id": F.when(~lost & (F.col("result") != "missing"), F.col("target_id")),
        "mismatch_attributes": F.when(lost | F.col("wrong").isNull(), "").otherwise(F.array_join("wrong", ",")),
    }).drop("wrong")


def judge_pairs(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) with the relation of their last answer (left_id, right_id, relation, axis, pos); answers on other
    pairs are ignored, and a pair without one stays, as unknown and decided by nobody."""
    last = answers.groupBy("left_id", "right_id").agg(F.max_by(F.struct("relation", "axis"), "pos").alias("_a"))
    rows = pairs.join(last, ["left_id", "right_id"], "left")
    absent = F.col("_a").isNull()
    relation = F.when(absent, "unknown").otherwise(coerce("_a.relation", RELATION_WORDS, "unknown"))
    return rows.withColumns({"relation": relation, "axis": F.when(relation == "differs_by", F.coalesce("_a.axis", F.lit(""))).otherwise(""), "decided_by": F.when(absent, "").otherwise("model"), "reason": F.when(absent, "no answer for this pair").otherwise("")}).drop("_a")


def keep_known_ids(rows: DataFrame, asked: str, allowed: str) -> DataFrame:
    """Rows whose ids (array ``asked``) are among ``allowed``, the ids cut to those, in their order and as often; ``dropped`` marks rows
    of which none is left."""
    kept = F.filter(asked, lambda i: F.array_contains(allowed, i))
    return rows.withColumn(asked, kept).withColumn("dropped", F.coalesce(F.size(kept), F.lit(0)) <= 0)


def judge_items(items: DataFrame, candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Items with verdict, n_candidates and matched ids: without a candidate not_found, else the answer (key, verdict, matched_ids),
    where what is no known verdict counts as different; of the matched ids only candidates stay."""
    per = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"), F.collect_set("candidate_id").alias("_ids"))
    rows = items.join(per, key, "left").join(answers, key, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    none = F.col("n_candidates") == 0
    matched = F.when(none | F.col("matched_ids").isNull(), F.array().cast("array<string>")).otherwise(F.filter("matched_ids", lambda i: F.array_contains("_ids", i)))
    return rows.withColumn("verdict", F.when(none, "not_found").otherwise(coerce("verdict", ITEM_WORDS, "different"))).withColumn("matched_ids", matched).drop("_ids")


def split_batch(size: str, place: str, depth: int = 3, least: int = 1) -> tuple:
    """(start, length) columns of the piece that the row at ``place`` (from 0) of a batch of ``size`` falls into when the batch is
    halved ``depth`` times; pieces of ``least`` rows are left whole."""
    start, length = F.lit(0).cast("long"), F.col(size).cast("long")
    for _ in range(depth):
        half = F.floor(length / 2)
        cut, right = length > least, F.col(place) - start >= half
        start, length = F.when(cut & right, start + half).otherwise(start), F.when(~cut, length).when(right, length - half).otherwise(half)
    return start, length


def review_rows(edges: DataFrame, notes: dict[str, str], limit: int = 80) -> DataFrame:
    """Edges left unknown as report lines: (left_name, right_name, line) with why the code refused them."""
    known = F.create_map(*(F.lit(x) for pair in notes.items() for x in pair))[F.col("rejected_by")]
    rejected = F.coalesce(known, F.when(~is_blank("rejected_by"), F.col("rejected_by")), F.lit("-"))
    reason = F.when(is_blank("reason"), "undecided").otherwise(truncate(collapse("reason"), limit))
    return edges.where("relation = 'unknown'").select("left_name", "right_name", table_line("left_name", "right_name", rejected, reason).alias("line"))
