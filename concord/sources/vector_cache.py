"""A cache of vectors by model, kind and text: what was embedded once is never embedded again.

The store is partitioned by the first digits of a digest and each file has a Bloom filter of its digests, so a lookup reads the
partitions it asks for and skips files that cannot hold them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import written
from .staged import stored_table

#: Hex digits of a digest that name its partition.
PREFIX = 2


def with_vectors(items: DataFrame, path: str, model: str, kind: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row of ``items`` (text, ...) with ``vector`` and ``cached`` (true if the store at ``path`` had it).

    ``embed`` gets the distinct texts (digest, text) that the store lacks and adds ``vector``; ``kind`` tells texts that are searched
    for (query) from those that are searched (passage), as models treat them apart.  A text for which ``embed`` gives nothing has a
    null vector and is asked again next time.  Null texts have no vector.
    """
    spark = items.sparkSession
    digest = F.sha1(F.concat_ws("\0", F.lit(model), F.lit(kind), F.col("text").cast("string")))
    marked = items.withColumn("_digest", F.when(F.col("text").isNotNull(), digest)).withColumn("_prefix", F.substring("_digest", 1, PREFIX))
    wanted = written(marked.where("_digest is not null").groupBy("_digest", "_prefix").agg(F.first("text").alias("text")), "wanted")
    held = stored_table(spark, path)
    if held is None:
        found, todo = None, wanted
    else:
        # at most 16 ** PREFIX prefixes
        prefixes = [r["_prefix"] for r in wanted.select("_prefix").distinct().collect()]
        near = held.where(F.col("prefix").isin(prefixes)).select(F.col("digest").alias("_digest"), "vector")
        found = written(near.join(wanted.select("_digest"), "_digest", "left_semi").groupBy("_digest").agg(F.first("vector").alias("vector")), "found")
        todo = wanted.join(found.select("_digest"), "_digest", "left_anti")
    made = written(embed(todo.select(F.col("_digest").alias("digest"), "text")).where("vector is not null").select("digest", "vector"), "made")
    if not made.isEmpty():
        fresh = made.select("digest", "vector", F.substring("digest", 1, PREFIX).alias("prefix")).repartition("prefix")
        fresh.write.mode("append").partitionBy("prefix").option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").parquet(path)
    known = made.select(F.col("digest").alias("_digest"), "vector", F.lit(False).alias("cached"))
    if found is not None:
        known = known.unionByName(found.select("_digest", "vector", F.lit(True).alias("cached")))
    return marked.join(known, "_digest", "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop("_digest", "_prefix")


def cache_stats(rows: DataFrame) -> DataFrame:
    """One row: texts, hits and misses of ``with_vectors``."""
    return rows.agg(F.count("text").alias("texts"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached") & F.col("text").isNotNull()).alias("misses"))
