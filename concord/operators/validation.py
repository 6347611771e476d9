"""Checks of facts and graphs as rows (fact_id, check_name, severity, reason), and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, tokens
from .facts import check_bounds, check_numeric_coverage, check_units

# The least share of an evidence's tokens that its document has, and how many missing ones are shown.
EVIDENCE_SHARE, EVIDENCE_SAMPLES = 0.8, 5


def _check(fact_id: Column, name: str, severity: str, reason: Column) -> tuple:
    return fact_id.alias("fact_id"), F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), reason.alias("reason")


def document_tokens(texts: DataFrame) -> DataFrame:
    """(doc, token): the distinct tokens of each document's texts (doc, text)."""
    return texts.select("doc", F.explode(F.array_distinct(tokens("text"))).alias("token")).distinct()


def check_evidence(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Errors for facts (doc, fact_id, evidence_text, attributes) that claim attributes without evidence, or whose evidence has fewer
    than ``EVIDENCE_SHARE`` of its distinct tokens in its document; the reason holds the share and the first missing tokens."""
    bare = facts.where(is_blank("evidence_text") & (F.size("attributes") > 0)).select(*_check(F.col("fact_id"), "evidence_missing", "error", F.lit("empty")))
    claimed = facts.where(~is_blank("evidence_text")).select("doc", "fact_id", F.explode(F.array_distinct(tokens("evidence_text"))).alias("token"))
    seen = claimed.join(document_tokens(texts).withColumn("_seen", F.lit(True)), ["doc", "token"], "left")
    per = seen.groupBy("doc", "fact_id").agg(F.count(F.lit(1)).alias("n"), F.count("_seen").alias("hit"), F.array_sort(F.collect_list(F.when(F.col("_seen").isNull(), F.col("token")))).alias("lost"))
    share = F.col("hit") / F.col("n")
    reason = F.concat(F.round(share, 4).cast("string"), F.lit(": "), F.array_join(F.slice("lost", 1, EVIDENCE_SAMPLES), " "))
    return bare.unionByName(per.where(share < EVIDENCE_SHARE).select(*_check(F.col("fact_id"), "evidence_missing", "error", reason)))


def check_source_kinds(facts: DataFrame, locators: DataFrame) -> DataFrame:
    """Errors for facts (doc, fact_id, doc_type, row, block_ids, slide_no, shape_ids) at places that their document (doc, kind, locator)
    lacks.  Rows and slides are only checked where the document has any; shapes only on a slide that is there."""
    one = lambda kind, at: F.array(F.struct(F.lit(kind).alias("kind"), at.cast("string").alias("locator")))
    many = lambda kind, ids: F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("string").alias("locator")))
    none = F.array().cast("array<struct<kind:string,locator:string>>")
    asked = F.when(F.col("doc_type") == "excel", F.when(F.col("row").isNotNull(), one("row", F.col("row")))).when(F.col("doc_type") == "word", many("block", F.col("block_ids")))
    asked = asked.when(F.col("doc_type") == "ppt", F.concat(F.when(F.col("slide_no").isNotNull(), one("slide", F.col("slide_no"))).otherwise(none), F.coalesce(many("shape", F.col("shape_ids")), none)))
    rows = facts.select("doc", "fact_id", F.explode(asked).alias("p")).select("doc", "fact_id", "p.kind", "p.locator")
    places = locators.select("doc", "kind", F.col("locator").cast("string").alias("locator")).distinct()
    kinds = places.groupBy("doc", "kind").agg(F.lit(True).alias("_any"))
    lost = rows.join(places, ["doc", "kind", "locator"], "left_anti").join(kinds, ["doc", "kind"], "left").where("kind in ('block', 'shape') or _any")
    per = lost.groupBy("doc", "fact_id").agg(F.min_by("kind", F.array_position(F.array(*map(F.lit, ("row", "block", "slide", "shape"))), F.col("kind"))).alias("kind"), F.array_sort(F.collect_set(F.struct("kind", "locator"))).alias("p"))
    ids = F.array_join(F.transform(F.filter("p", lambda x: x["kind"] == F.col("kind")), lambda x: x["locator"]), ", ")
    return per.select(*_check(F.col("fact_id"), "source_unresolvable", "error", F.concat("kind", F.lit(" "), ids)))


def validate_facts(facts: DataFrame, texts: DataFrame, locators: DataFrame) -> DataFrame:
    """All checks of facts in one table."""
    out = check_bounds(facts)
    for more in (check_units(facts), check_numeric_coverage(facts), check_evidence(facts, texts), check_source_kinds(facts, locators)):
        out = out.unionByName(more)
    return out


def low_confidence(checks: DataFrame) -> DataFrame:
    """The facts that any error names."""
    return checks.where("severity = 'error'").where(~is_blank(F.col("fact_id").cast("string"))).select("fact_id").distinct()


def validate_graph(edges: DataFrame, members: DataFrame, pair: Column | None = None) -> DataFrame:
    """Checks of edges (left_id, right_id, relation, rejected_by, reason), named by their pair of ids: ends that are no member
    (fact_id), edges that the code refused, pairs left unknown, and pairs that are both the same and different.

    A pair is the same whichever way an edge points; where both sides use the same numbers, ``pair`` names it instead.
    """
    if pair is None:
        pair = F.concat(F.least("left_id", "right_id").cast("string"), F.lit(" ~ "), F.greatest("left_id", "right_id").cast("string"))
    rows = edges.withColumn("pair", pair)
    ends = rows.select("pair", F.explode(F.array("left_id", "right_id")).alias("fact"))
    loose = ends.join(members.select(F.col("fact_id").alias("fact")).distinct(), "fact", "left_anti")
    out = loose.select(*_check(F.col("pair"), "concept_dangling_node", "error", F.col("fact").cast("string")))
    refused = F.col("rejected_by").isin("evidence", "differs_by")
    out = out.unionByName(rows.where(refused).select(*_check(F.col("pair"), "concept_rejected", "error", F.col("rejected_by"))))
    open_ = rows.where(~F.coalesce(refused, F.lit(False)) & (F.col("relation") == "unknown"))
    out = out.unionByName(open_.select(*_check(F.col("pair"), "concept_unknown_pair", "warn", F.when(is_blank("reason"), "undecided").otherwise(F.col("reason")))))
    both = rows.groupBy("pair").agg(F.bool_or(F.col("relation") == "same_as").alias("s"), F.bool_or(F.col("relation") == "differs_by").alias("d")).where("s and d")
    return out.unionByName(both.select(*_check(F.col("pair"), "concept_contradiction", "error", F.lit("same_as, differs_by"))))
