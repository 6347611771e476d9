"""Timelines and progress: durations, symptoms, running progress, stalls, sliding rates, admission times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def stage_durations(events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Pairs of a start event and the next end event of one key: (key, event_id, ts, seconds)."""
    window = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = events.where(F.col("event_type").isin(start, end)).withColumn("_next", F.lead(F.struct("event_type", "ts")).over(window))
    paired = marked.where((F.col("event_type") == start) & (F.col("_next.event_type") == end))
    return paired.select(key, "event_id", "ts", F.round((micros("_next.ts") - micros("ts")) / 1e6, 3).alias("seconds"))


def symptoms(events: DataFrame, key: str, **predicates: Column) -> DataFrame:
    """One row per key and symptom that any of its events shows; each event is only counted, not judged."""
    flags = events.groupBy(key).agg(*(F.bool_or(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()))
    stacked = F.array_compact(F.array(*(F.when(F.col(n), F.struct(F.lit(k).alias("ord"), F.lit(n).alias("symptom"))) for k, n in enumerate(predicates, 1))))
    return flags.select(key, F.explode(stacked).alias("s")).select(key, "s.ord", "s.symptom")


def running_fraction(events: DataFrame, key: str, done: Column, total: str) -> DataFrame:
    """Progress of each key after each event, never falling: finished so far over all."""
    window = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum(F.when(done, 1).otherwise(0)).over(window) / F.col(total)
    return events.withColumn("_part", F.least(F.lit(1.0), part)).withColumn("fraction", F.round(F.max("_part").over(window), 6)).drop("_part")


def stalls(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Gaps of over ``seconds`` between an event and the next of its key: (key, event_id, idle)."""
    window = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = (micros(F.lead("ts").over(window)) - micros("ts")) / 1e6
    return events.withColumn("idle", F.round(gap, 3)).where(F.col("idle") > seconds).select(key, "event_id", "idle")


def sliding_count(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each event with the number of events of its key in the window of ``seconds`` that ends with it."""
    window = Window.partitionBy(key).orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(window))


def admissions(events: DataFrame, key: str, most: int, seconds: float = 60.0) -> DataFrame:
    """When a limiter of ``most`` calls in any ``seconds`` lets each call of a key pass, in order of arrival.

    Each key's admissions depend on all earlier ones, so they fold in one task.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["arrival", "event_id"])
        out: list[float] = []
        for arrival in rows["arrival"]:
            at = max(arrival, out[-1]) if out else arrival
            if len(out) >= most:
                at = max(at, out[-most] + seconds)
            out.append(at)
        return pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "waited": [round(o - a, 3) for o, a in zip(out, rows["arrival"], strict=True)]})

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_id", (micros("ts") / 1e6).alias("arrival")).groupBy(key).applyInPandas(fold, f"{key} {kind}, event_id long, waited double")


def expired(jobs: DataFrame, now: Column, days: int, final: Column) -> DataFrame:
    """Final jobs older than ``days``."""
    return jobs.where(final & (F.col("ts") < now - F.make_dt_interval(F.lit(days))))


def queue_positions(jobs: DataFrame, lane: str, queued: Column, running: Column, created: str, job: str) -> DataFrame:
    """Place of each queued job of a lane: how many run, and how many were queued before it."""
    active = jobs.groupBy(lane).agg(F.max(F.when(running, 1).otherwise(0)).alias("_running"))
    number = F.row_number().over(Window.partitionBy(lane).orderBy(created, job)) - 1
    waiting = jobs.where(queued).withColumn("_n", number)
    return waiting.join(active, lane).select(lane, job, (F.col("_n") + F.col("_running")).cast("long").alias("position"))


def rate(amount: Column, ms: Column) -> Column:
    """Per second, to one place; null without an amount or a duration."""
    return F.when((amount > 0) & (ms > 0), F.round(amount * 1000.0 / ms, 1))


def backoff(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait before an attempt."""
    return F.least(F.pow(F.lit(base), attempt), F.lit(cap))


def filter_records(records: DataFrame, floor: str, part: str, levels: tuple[str, ...] = ("DEBUG", "INFO", "WARNING", "ERROR")) -> DataFrame:
    """Log records (level, text) of at least a level (one without counts as INFO) whose text holds ``part``, whatever the case."""
    place = F.array_position(F.array(*(F.lit(x) for x in levels)), F.coalesce(F.nullif("level", F.lit("")), F.lit("INFO")))
    return records.where((place >= levels.index(floor) + 1) & F.contains(F.lower("text"), F.lit(part.lower())))
