"""Timelines of runs: nested stages from start and end events, their own time, symptoms in order, durations longest first.

A run's events are matched by windows over its key, in order of time; a run is one bounded sequence that one process wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import contained
from .events import micros, symptoms

# Kinds of events, the word of a retry over a broken answer, and symptoms in reporting order.
STAGE_START, STAGE_END, CALL_END, RETRY = "stage_start", "stage_end", "llm_end", "retry"
PARSE_REASON = "파싱"
SYMPTOMS = ("timeout", "length", "reasoning", "rate_limit", "empty_output", "parse", "slow")


def nested_stages(events: DataFrame, key: str, starts: Column, ends: Column, order: tuple[str, ...] = ("ts", "event_id"), start_id: str = "event_id") -> DataFrame:
    """(key, start id, depth, parent_id, seconds, self_seconds) of every stage that an event opens and a later one closes.

    An end closes the last open start.  Ends with nothing open are ignored; a stage that nothing closes has no seconds.  The depth
    is 0 for a stage in no other; ``self_seconds`` is its time without that of the stages directly inside it.

    Brackets are matched by windows alone: with +1 for a start and -1 for an end, the running sum less its running minimum (no more
    than 0) is the number of open stages, and at one depth starts and ends alternate.
    """
    run = Window.partitionBy(key).orderBy(*order)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    marks = events.select(key, *dict.fromkeys([*order, start_id]), F.when(starts, 1).when(ends, -1).alias("_d")).where(F.col("_d").isNotNull())
    summed = marks.withColumn("_s", F.sum("_d").over(so_far))
    lowest = summed.withColumn("_low", F.least(F.lit(0), F.min("_s").over(so_far)))
    before = F.coalesce(F.lag("_low").over(run), F.lit(0))
    known = lowest.withColumn("_stray", (F.col("_d") < 0) & (F.col("_s") < before)).where("not _stray")
    level = F.when(F.col("_d") > 0, F.col("_s") - F.col("_low") - 1).otherwise(F.col("_s") - F.col("_low")).cast("int")
    placed = known.withColumn("depth", level).withColumn("_at", micros(order[0]))
    same = Window.partitionBy(key, "depth").orderBy(*order)
    # a start also stands at the depth below it, as the parent of what follows there
    own = placed.select(key, *order, F.col("depth"), F.col("_at"), F.col("_d"), F.col(start_id).alias("_id"), F.lit(None).cast(placed.schema[start_id].dataType).alias("_parent"))
    outer = placed.where("_d > 0").select(key, *order, (F.col("depth") + 1).alias("depth"), F.col("_at"), F.lit(0).alias("_d"), F.col(start_id).alias("_id"), F.col(start_id).alias("_parent"))
    level_rows = own.unionByName(outer).withColumn("_parent", F.last("_parent", True).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    paired = level_rows.where("_d <> 0").withColumn("_next", F.lead(F.struct("_d", "_at")).over(same)).where("_d > 0")
    seconds = F.when(F.col("_next._d") < 0, F.round((F.col("_next._at") - F.col("_at")) / 1e6, 6))
    stages = paired.select(key, F.col("_id").alias(start_id), "depth", F.when(F.col("depth") > 0, F.col("_parent")).alias("parent_id"), seconds.alias("seconds"))
    inside = stages.where("parent_id is not null").groupBy(key, F.col("parent_id").alias(start_id)).agg(F.sum("seconds").alias("_inside"))
    return stages.join(inside, [key, start_id], "left").withColumn("self_seconds", F.round(F.col("seconds") - F.coalesce("_inside", F.lit(0.0)), 6)).drop("_inside")


def stage_summary(events: DataFrame, key: str, name: Column, seconds: Column, depth: Column, status: Column) -> DataFrame:
    """(key, place, name, seconds, status) of the finished stages of depth 0, longest first; no status is ok."""
    top = events.where(F.coalesce(depth, F.lit(0)) == 0).select(key, name.alias("name"), seconds.alias("seconds"), F.coalesce(F.nullif(status, F.lit("")), F.lit("ok")).alias("status"))
    return top.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seconds"), "name", "status")))


def document_durations(stages: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, seconds, failed): finished stages (name, seconds, status) whose name holds a document's label, summed; failed if one
    ended in an error.  Labels are found by one automaton over the names."""
    labels = documents.select(F.col("document").alias("name")).distinct()
    found = contained(stages.select(F.col("name").alias("stage"), "seconds", "status"), F.col("stage"), ["stage", "seconds", "status"], labels)
    return found.groupBy(F.col("name").alias("document")).agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.bool_or(F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed"))


def run_symptoms(events: DataFrame, key: str) -> DataFrame:
    """(key, ord, symptom) of timeline events (kind, status, failed, output_chars, reasoning_tokens, reason, slow): what was seen, in the
    fixed order, counted and not judged."""
    cut = F.col("status") == "length"
    return symptoms(
        events, key,
        timeout=F.col("status") == "timeout", length=cut, reasoning=cut & (F.col("reasoning_tokens") > 0), rate_limit=F.col("status") == "rate_limit",
        empty_output=(F.col("kind") == CALL_END) & ~F.coalesce("failed", F.lit(False)) & (F.col("output_chars") == 0),
        parse=(F.col("kind") == RETRY) & F.contains(F.coalesce("reason", F.lit("")), F.lit(PARSE_REASON)), slow=F.coalesce("slow", F.lit(False)),
    )
