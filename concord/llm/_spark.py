"""Shared Spark helpers: a scratch folder all executors see, written intermediates, gapless ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.  Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by its key, never broadcast.  Spark sizes a table by its compressed files, and what is
    exploded or pieced together from it no higher, so it would send far more than it expects through the driver."""
    return df.hint("merge")


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def cuts(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``most`` bytes each (one longer text stays whole)."""
    if not len(text):
        return
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < len(text):
        to = min(len(text), max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
        yield at, to - at
        at = to


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text in each is about ``most`` bytes (one longer text stays whole)."""
    for batch in batches:
        for at, length in cuts(batch.column(batch.schema.get_field_index(column)), most):
            yield batch.slice(at, length)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a number ``_row`` of each row, by which equal rows are told apart ever after."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()), name)


def rank_in_key(df: DataFrame, key: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each ``key`` of a ``numbered`` table from 0 without gaps, however many rows one key holds.

    A key's rows (``rows`` at most) are dealt to buckets by the hash of their number, so equal rows part too; only bucket
    counts meet in one window, then every row adds its rank in its bucket to the rows of earlier buckets.  A bucket has
    about a thousand rows, or their square root where a key has more than a million.
    """
    buckets = max(1, -(-rows // max(1000, math.isqrt(rows))))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    before = (
        spread.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .drop("_n")
    )
    inside = spread.withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order, "_row")) - 1)
    return inside.join(before, [*key, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_before", "_rank", "_bucket", "_row")
