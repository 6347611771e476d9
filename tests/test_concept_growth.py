"""Concept graphs: what a quote costs, and what goes by rounds."""

import random

from pyspark.sql import functions as F
from test_once import plan

from concord.functions.text import TOKEN
from concord.operators import graph as G


def test_words_of_a_quote_are_found_once(spark):
    claims = spark.createDataFrame([("one two three", "one two three four", "", "x"), ("one", "one two", "", "two"), ("x", "y", "", "X"), ("", "one", "", ""), (None, "one", "", "one"), ("one two", "one two", None, None), ("!", "!", "", "")], "quote string, evidence_text string, search_text string, entity_name string")
    got = G.verify_quotes(claims)
    # four texts, each with and without runs that are taken apart
    assert plan(got).count(TOKEN) <= 8
    assert [r["verified"] for r in got.collect()] == [True, False, True, False, False, True, False]


def test_neighbours_stand_in_one_batch(spark, monkeypatch):
    """Edges that come dealt anyhow are contracted where they stand: what goes by rounds does not grow with them."""
    from concord.operators import concepts as C

    met = []
    keep = G._by_rounds
    monkeypatch.setattr(G, "_by_rounds", lambda near: met.append(near.count()) or keep(near))
    n, rng = 3000, random.Random(2)
    keys = rng.sample(range(n), n)
    fact = "doc string, fact_id long, entity_name string, pos long, evidence_text string, search_text string"
    ref = spark.createDataFrame([("r", k, f"n{k}", k, "", "") for k in keys], fact)
    targets = spark.createDataFrame([("a", k, f"n{k}", k, "", "") for k in keys], fact)
    pairs = ref.select(F.col("fact_id").alias("ref_id"), F.lit("a").alias("target_doc"), F.explode(F.array("fact_id", F.when(F.col("fact_id") % 5 > 0, F.col("fact_id") - 1))).alias("target_id")).where("target_id is not null")
    proven = pairs.select("*", F.lit("same_as").alias("relation"), F.lit("code").alias("decided_by"), F.lit(True).alias("recalled"), F.lit(1).alias("place"), F.lit(False).alias("promoted"), F.lit("").alias("reason"), F.lit("").alias("rejected_by")).repartition(7, "ref_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        graph = C.assemble(ref, targets, proven)
        roots = {r["id"]: r["root"] for r in graph._roots.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(met) < 200 and len(set(roots.values())) == n // 5 and len(roots) == 2 * n
    assert all(roots[f"r#{k}"] == roots[f"a#{k}"] == min(f"a#{j}" for j in range(k - k % 5, k - k % 5 + 5)) for k in range(n))
