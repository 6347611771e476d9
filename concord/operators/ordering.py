"""Row numbers in a global order, or within keys of any size, without a window over one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do without ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and survives a lost executor.

    The files stay, as other DataFrames may read them; the folder is cleared between applications.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by its key, never broadcast.  Spark sizes a table by its compressed files and by the
    kinds of the columns that are left of it, so it would send far more than it expects through the driver."""
    return df.hint("merge")


def number_rows(rows: DataFrame, order: list[Column | str], name: str, key: list[str] | None = None) -> DataFrame:
    """``rows`` with their number from 1 by ``order``, or by ``order`` within each ``key`` (rows are dealt by ranges of the order,
    so a key may hold any number of them).

    Rows are sorted in ranges and written; a row's number is its place in its range plus the rows of earlier ranges.
    """
    by = [F.col(f"`{k}`") for k in key or []] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_nr_m", F.monotonically_increasing_id())
    marked = written(dealt, "numbered").withColumn("_nr_part", F.shiftright("_nr_m", 33)).withColumn("_nr_at", F.col("_nr_m").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = marked.groupBy("_nr_part").agg(F.count(F.lit(1)).alias("_nr_n"))
    # one row per range of the sort
    before = parts.withColumn("_nr_before", F.sum("_nr_n").over(Window.orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_nr_n")).select("_nr_part", "_nr_before")
    placed = marked.join(F.broadcast(before), "_nr_part").withColumn("_nr_place", F.col("_nr_before") + F.col("_nr_at"))
    if key:
        first = placed.groupBy(*key).agg(F.min("_nr_place").alias("_nr_first"))
        keys = [F.col(f"`{k}`").alias(f"_nr_k{i}") for i, k in enumerate(key)]
        joined = placed.join(first.select(*keys, "_nr_first"), [placed[k].eqNullSafe(F.col(f"_nr_k{i}")) for i, k in enumerate(key)])
        placed = joined.withColumn("_nr_place", F.col("_nr_place") - F.col("_nr_first"))
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_nr_place") + 1).cast("long").alias(name))
