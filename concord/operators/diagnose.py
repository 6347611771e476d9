"""Why a counterpart was missed, and scoring against labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, norm_name
from .containment import contained
from .ordering import number_rows
from .overlap import shared_tokens


def missing_cause(case: DataFrame) -> DataFrame:
    """The first cause that applies to each missing comparison with columns decided_by_model, edge_rejected, edge_unknown,
    n_blockers, n_cited_blocks, n_candidates, n_kept, best_score and floor.  A recall that kept candidates lost their edge."""
    cause = (
        F.when(F.col("decided_by_model"), "f5_llm")
        .when(F.col("edge_rejected"), "evidence_gate")
        .when(F.col("edge_unknown"), "llm_undecided")
        .when(F.col("n_blockers") > 0, "blocked")
        .when(F.col("n_cited_blocks") == 0, "extraction")
        .when(F.col("n_candidates").isNull(), "unresolved")
        .otherwise("recall")
    )
    detail = F.when(F.col("n_candidates") == 0, "empty").when(F.col("n_kept") > 0, "no_edge").when(F.col("best_score") < F.col("floor"), "min_score").otherwise("top_k")
    return case.withColumn("cause", cause).withColumn("subcause", F.when(cause == "recall", detail).otherwise(""))


def confusion(joined: DataFrame, expected: str, predicted: str, classes: list) -> DataFrame:
    """Counts of every expected and predicted class, zeros included."""
    session = joined.sparkSession
    names = session.createDataFrame([(a, b) for a in classes for b in classes], f"{expected} {dict(joined.dtypes)[expected]}, {predicted} {dict(joined.dtypes)[predicted]}")
    counts = joined.groupBy(expected, predicted).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(names).join(counts, [expected, predicted], "left").select(expected, predicted, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def recall_at(ranks: DataFrame, ks: tuple[int, ...], group: str) -> DataFrame:
    """Per group: share of queries ranked within each k, mean rank of those found, and how many were not."""
    found = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(group).agg(*found, F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank").isNull()).alias("undetected"))


def first_match_join(golden: DataFrame, comparisons: DataFrame, key: str, order: str) -> DataFrame:
    """Labelled rows with the first comparison of their key."""
    first = comparisons.groupBy(key).agg(F.min_by("result", order).alias("result"))
    return golden.join(first, key)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def best_overlap(golden: DataFrame, facts: DataFrame, floor: float = 0.3) -> DataFrame:
    """(golden_id, fact_id, overlap): of all facts (fact_id, fact_text) the one of greatest token overlap (Jaccard) with each golden
    text, the first of equals; none below ``floor``.

    Blocks of golden texts meet blocks of facts (see ``shared_tokens``) and pass on what can be best; that is scored exactly.
    """
    found = shared_tokens(golden, facts, lambda both, n, m: both / (n + m - both), floor, best=True)
    overlap = F.col("shared") / (F.col("n_golden") + F.col("n_fact") - F.col("shared"))
    scored = found.select("golden_id", "fact_id", F.round(overlap, 6).alias("overlap")).where(F.col("overlap") >= floor)
    best = F.max_by(F.struct("fact_id", "overlap"), F.struct("overlap", -F.col("fact_id")))
    return scored.groupBy("golden_id").agg(best.alias("b")).select("golden_id", "b.fact_id", "b.overlap")


def mentions(entities: DataFrame, blocks: DataFrame, cited: DataFrame, doc: str, block: str) -> DataFrame:
    """(doc, block, entity_name): uncited blocks of an entity's document that mention it: its normalised name lies in the block, or a
    token of two or more characters is shared.  ``cited`` has the (doc, block) that facts cite.

    Names are found by one automaton over each block, tokens by a join on document and token.
    """
    free = blocks.join(cited.select(doc, block), [doc, block], "left_anti")
    named = entities.select(doc, "entity_name").distinct().withColumn("name", norm_name("entity_name"))
    held = contained(free, norm_name("block_text"), [doc, block], named).join(named, [doc, "name"]).select(doc, block, "entity_name")
    words = F.filter(F.array_distinct(tokens("entity_name")), lambda t: F.length(t) >= 2)
    asked = named.select(doc, "entity_name", F.explode(words).alias("token"))
    said = free.select(doc, block, F.explode(F.array_distinct(tokens("block_text"))).alias("token")).join(asked.select(doc, "token").distinct(), [doc, "token"], "left_semi")
    return held.unionByName(said.join(asked, [doc, "token"]).select(doc, block, "entity_name")).distinct()


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the upper median of each key's values, by their numbers in order; a key may hold any number of rows."""
    full = rows.select(key, value).where(F.col(value).isNotNull())
    counts = full.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(full, [value], "_place", [key]).join(counts, key)
    return numbered.where(F.col("_place") == F.floor(F.col("_n") / 2) + 1).select(key, F.col(value).alias("median"))
