"""Ordered batches: fixed size, context of the batch before, carry-over, greedy packing, numbered keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_rows


def number_batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Rows of each key in order, ``size`` to a batch, batches from 0."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("batch", F.floor(F.col("pos") / size).cast("int"))


def previous_context(batched: DataFrame, key: str, item: Column, last: int = 3) -> DataFrame:
    """(key, batch, context): the last items of the batch before."""
    lists = batched.groupBy(key, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("v")))), lambda s: s["v"]).alias("items"))
    before = F.lag("items").over(Window.partitionBy(key).orderBy("batch"))
    return lists.withColumn("_before", before).select(key, "batch", F.coalesce(F.slice("_before", F.greatest(F.lit(1), F.size("_before") - last + 1), F.lit(last)), F.array().cast("array<string>")).alias("context"))


def carry_over(batched: DataFrame, key: str, value: str) -> DataFrame:
    """(key, batch, carried): the last non-empty value of all earlier batches."""
    per = batched.groupBy(key, "batch").agg(F.max_by(value, F.when(F.coalesce(F.col(value), F.lit("")) != "", F.col("pos"))).alias("_last"))
    window = Window.partitionBy(key).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(key, "batch", F.coalesce(F.last(F.nullif("_last", F.lit("")), ignorenulls=True).over(window), F.lit("")).alias("carried"))


def pack_groups(groups: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Groups stay whole; a new batch begins when a group would overfill one that has rows.  One key's groups fold in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        batch, used, out = 0, 0, []
        for n in rows[size]:
            if used and used + n > limit:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return rows.assign(batch=out)[[key, order, size, "batch"]]

    kinds = dict(groups.dtypes)
    return groups.groupBy(key).applyInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in (key, order, size)) + ", batch int")


def occurrence_keys(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names, and from the second occurrence on with ``#n``."""
    return number_rows(rows, [order], "_n", [name]).withColumn("unit_key", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("#"), F.col("_n").cast("string")))).drop("_n")


def group_records(lines: DataFrame, source: str, order: str, text: str, head: str) -> DataFrame:
    """Lines that do not match ``head`` belong to the record of the last one that does: (source, record, text)."""
    number = F.sum(F.when(F.col(text).rlike(head), 1).otherwise(0)).over(Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("record", number)
    return marked.groupBy(source, "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n").alias("text"))
