"""Lexical search deals a row of each text, not of each term, and no text twice."""

import random

import __spark_entry__ as entry
from concord.operators import retrieval as R


def test_texts_are_dealt_as_rows(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(25))) for k in range(40)], "doc_id long, text string")
    dealt, deal = [], R._dealt
    monkeypatch.setattr(R, "_dealt", lambda rows, *a: dealt.append(rows.count()) or deal(rows, *a))
    ask = lambda: sorted(map(tuple, R.bm25_top(df.where("doc_id % 4 = 0"), df, "doc_id", "doc_id", 5).select("query_id", "doc_id", "score", "rank").collect()))
    some = ask()
    assert len(some) == 50 and dealt == [10, 40]
    # many different terms asked for: documents keep all of theirs
    monkeypatch.setattr(R, "FEW_TERMS", 2)
    assert ask() == some


def test_rows_that_repeat_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a c"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a a"), (7, "a"), (8, "zz"), (9, None)], "q long, text string")
    got = [(r["query_id"], r["doc_id"], r["rank"]) for r in R.bm25_top(asked, docs, "q", "doc_id", 3).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 2)]
    assert R.bm25_top(asked, docs.limit(0), "q", "doc_id", 3).count() == 0 == R.bm25_top(asked.limit(0), docs, "q", "doc_id", 3).count()


def test_fusion_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert entry.queries()["rrf_fusion"](spark, str(tmp_path)).count() == 0
