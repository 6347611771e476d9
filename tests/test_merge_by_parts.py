"""Components and merging: batch by batch, by folds and by rounds give the same."""

import random

from pyspark.sql import functions as F
from test_concepts import EDGES, fold

from concord.operators import graph as G


def test_components_of_scattered_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2500)] + [(5000 + k, 5001 + k) for k in range(900)] + [(7, 7), (9000, 9000)]
    rng.shuffle(edges)
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = G.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
        text = G.components(spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in edges], "a string, b string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in least} and len(got) == len(least)
    assert {r["node"]: r["component"] for r in text} == {f"n{x:05}": f"n{find(x):05}" for x in least}


def test_small_components_need_no_rounds(spark, monkeypatch):
    """Components of up to the given size are folded, larger ones go by rounds, with the same result."""
    rng = random.Random(5)
    edges = []
    for block in range(60):
        n = rng.randrange(2, 9)
        edges += [(len(edges) + k, block * 10 + rng.randrange(n), block * 10 + rng.randrange(n), rng.choice(["same_as", "same_as", "same_as", "differs_by"]), rng.random() < 0.3) for k in range(12)]
    edges += [(9000, 1, 11, "differs_by", False), (9001, 700, 701, "differs_by", False), (9002, 702, 702, "same_as", False)]
    fate, least = fold(edges)
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    for folded in (100, 14, 0):
        got = G.constrained_merge(df, folded=folded).collect()
        assert {r["id"]: r["value"] for r in got if r["kind"] == "edge"} == fate
        assert {r["id"]: r["value"] for r in got if r["kind"] == "node"} == least and len(got) == len(fate) + len(least)
    monkeypatch.setattr(G, "_merge_by_rounds", None)
    assert G.constrained_merge(df).where(F.col("kind") == "edge").count() == len(fate)
