"""Joins whose sides grow with the input stay off the driver, however small Spark takes them to be."""

from pyspark.sql import functions as F

from concord.llm import spelling
from concord.operators import concepts as C
from concord.operators import matching as J
from concord.queries import concepts as Q
from concord.queries.graphs import ontology

SMALL = "/root/testdata/sf0.001"


def _sent(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_words_are_not_broadcast(spark):
    words = spark.createDataFrame([(w,) for w in ("colour", "color", "colors", "harbour", "harbor")], "word string")
    assert _sent(spelling._edits(words, F.floor(F.length("word") / 2).cast("int"))) == 0
    assert _sent(spelling._along(words.selectExpr("word", "concat(word, '.') path"), words, 8)) == 0
    assert _sent(spelling.group_variants(spark.createDataFrame([(1, "colour color colour colors " * 3)], "doc_id long, text string"))) == 0


def test_facts_and_pairs_are_not_broadcast(spark):
    reference, targets = Q._facts(spark, SMALL)
    targets = targets.drop("l_partkey")
    ranked = reference.select(F.col("fact_id").alias("ref_id"), F.lit("A").alias("target_doc"), (F.col("fact_id") * 10 + 1).alias("target_id"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"), F.lit(False).alias("needs_review"))
    known = ontology(spark, SMALL)
    pairs = C.concept_pairs(reference, targets, ranked, known)
    answers = ranked.select(*C.PAIR, *(F.lit("").alias(c) for c in ("relation", "axis", "left_text", "right_text")), F.lit(1).alias("pos"))
    decided = C.decide(pairs, answers)
    for df in (targets, known, pairs, decided, J.attach(reference, targets, J.candidates(reference, targets, ranked))):
        assert _sent(df) == 0
    assert decided.count() > 100
