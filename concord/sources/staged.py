"""Staged tables: compute only what a stage has not seen, by fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def cached_or_compute(inputs: DataFrame, parts: list[str], path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every input row with its results, computing only rows whose digest of ``parts`` is not in the table at ``path`` yet; a row for
    which ``compute`` returns nothing comes back with nulls, and is computed again next time.

    ``compute`` gets one row of each new digest and keeps the column ``digest``; its results are appended.  Equal inputs are
    computed once and all come back.  The digest is the whole SHA-256 of the parts as JSON, in which null and empty differ.
    Result columns that the inputs have too are those of the inputs.
    """
    spark = inputs.sparkSession
    marked = inputs.withColumn("digest", F.sha2(F.to_json(F.array(*(F.struct(F.col(p).cast("string").alias("v")) for p in parts))), 256))
    stored = stored_table(spark, path)
    todo = marked.dropDuplicates(["digest"])
    if stored is not None:
        todo = todo.join(stored.select("digest"), "digest", "left_anti")
    compute(todo).write.mode("append").parquet(path)
    results = spark.read.parquet(path)
    fresh = [c for c in results.columns if c not in inputs.columns and c != "digest"]
    return marked.join(results.dropDuplicates(["digest"]).select("digest", *fresh), "digest", "left").select(*inputs.columns, *fresh)
