"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the least node reachable.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the graph's width.  Null
    ends and loops are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    state = materialise(pairs.distinct(), "edges")
    seen = None
    while True:
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(state.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialise(large, "large-star")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        state = materialise(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31))).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
