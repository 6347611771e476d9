import random

import corpus_pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    kinds = {"xx": ["ba", "ko", "ri", "mu", "so", "ta"], "yy": ["str", "ing", "ed", "th", "wo", "ly"]}
    rows, labels = [], []
    for k in range(240):
        lang = ("xx", "yy")[k % 2]
        words = ["".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(70)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(70), rng.choice(["idiot", "scumbag"]))
        rows.append((k, " ".join(words), lang, "s", 0))
        labels.append((k, 1, int(bad)))
    rows += [(500, rows[1][1], "yy", "s", 0), (501, "12 34", "xx", "s", 0), (502, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = set(range(240)) | {500, 501, 502}
    for name, gone in (("language", {501, 502}), ("toxicity", {k for k in range(240) if k % 4 == 0}), ("simhash", {500})):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        want -= gone
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r["doc_id"] for r in docs.collect()} == want, name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == want and corpus_pipeline.ORACLE_SQL is None
