"""Statistics of runs and of results against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_rows
from .overlap import shared_tokens


def class_totals(joined: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per expected class: rows, how many are predicted so, and how many that were not missing are said to be missing."""
    hit = F.col(expected) == F.col(predicted)
    said = (F.col(predicted) == "missing") & (F.col(expected) != "missing")
    return joined.groupBy(expected).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("right"), F.count_if(said).alias("wrongly_missing"), F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("accuracy"))


def calibration(scored: DataFrame, key: str) -> DataFrame:
    """Per strategy: least and greatest score of hits and of false matches; where all hits lie above all others, the middle
    between is the threshold."""
    hit = F.col("hit")
    score = lambda h: F.when(h, F.col("score"))
    per = scored.groupBy(key).agg(F.count_if(hit).alias("hits"), F.min(score(hit)).alias("hit_min"), F.max(score(hit)).alias("hit_max"), F.count_if(~hit).alias("others"), F.min(score(~hit)).alias("other_min"), F.max(score(~hit)).alias("other_max"))
    return per.withColumn("threshold", F.when(F.col("hit_min") > F.col("other_max"), F.round((F.col("hit_min") + F.col("other_max")) / 2, 6)))


def covering_facts(golden: DataFrame, facts: DataFrame, share: float) -> DataFrame:
    """(golden_id, fact_id, ratio, place): all facts that have ``share`` or more of a golden text's distinct tokens, best first.

    Blocks of golden texts meet blocks of facts (see ``shared_tokens``).
    """
    found = shared_tokens(golden, facts, lambda both, n, m: both / n, share)
    scored = found.select("golden_id", "fact_id", (F.col("shared") / F.col("n_golden")).alias("ratio")).where(F.col("ratio") >= share)
    place = F.row_number().over(Window.partitionBy("golden_id").orderBy(F.desc("ratio"), "fact_id"))
    return scored.withColumn("place", place).withColumn("ratio", F.round("ratio", 6))


def batch_stats(calls: DataFrame, key: str) -> DataFrame:
    """Per run of batches, from its calls (n_items, depth, status): calls, splits, deepest split, fewest items of a call."""
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "length").alias("splits"), F.max("depth").alias("max_depth"), F.min("n_items").alias("min_items"))


def run_summary(documents: DataFrame, key: str) -> DataFrame:
    """Per run: documents that ended well, that failed, and the names of those in order, by their last status (doc, status, pos)."""
    last = documents.groupBy(key, "doc").agg(F.max_by("status", "pos").alias("status"))
    bad = F.col("status") == "error"
    return last.groupBy(key).agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("doc")))), ", ").alias("failed_docs"))


def record_stats(rows: DataFrame, key: str) -> DataFrame:
    """Per sheet, from its rows (row, row_id of the record or null, n_columns): rows in, records out, rows without a record."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_in"), F.count_distinct("row_id").alias("rows_out"), F.count_if(F.col("row_id").isNull()).alias("without_row"), F.max("n_columns").alias("columns"))


def rank_right(right: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Right nodes (key, node, label) in drawing order (``place`` from 0): by the upper median of the left places (key, node, left_place)
    that link to them, unlinked ones last, equal ones by label and node."""
    w = Window.partitionBy(key, "node")
    numbered = links.withColumn("_n", F.row_number().over(w.orderBy("left_place"))).withColumn("_all", F.count(F.lit(1)).over(w))
    median = numbered.where(F.col("_n") == F.floor(F.col("_all") / 2) + 1).select(key, "node", F.col("left_place").alias("median"))
    placed = right.join(median, [key, "node"], "left").withColumn("_label", F.coalesce("label", F.lit("")))
    order = [F.asc_nulls_last("median"), F.asc("_label"), F.asc("node")]
    return number_rows(placed, order, "place", [key]).drop("_label").withColumn("place", F.col("place") - 1)


def snapshot_changes(snapshots: DataFrame, key: str, seconds: int) -> DataFrame:
    """What a watcher of each job is told at each look (ts, n_lines, seq, status, last_ts): new log lines, and whether progress, status
    or the stall (nothing new for ``seconds``) changed; looks that change nothing are left out."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    was = lambda c: F.lag(c).over(w)
    stalled = snapshots.withColumn("stalled", F.col("ts").cast("timestamp").cast("long") - F.col("last_ts").cast("timestamp").cast("long") > seconds)
    out = stalled.withColumns({
        "new_lines": F.greatest(F.col("n_lines") - F.coalesce(was("n_lines"), F.lit(0)), F.lit(0)),
        "progress": ~F.col("seq").eqNullSafe(was("seq")),
        "status_changed": ~F.col("status").eqNullSafe(was("status")),
        "stall_flip": F.col("stalled") != F.coalesce(was("stalled"), F.lit(False)),
    })
    return out.where("new_lines > 0 or progress or status_changed or stall_flip")
