"""Recall is measured over all vectors."""

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as entry
from concord.operators import retrieval as R

SMALL = "/root/testdata/sf0.001"


def test_every_vector_asks(spark):
    e = pq.read_table(f"{SMALL}/embeddings.parquet").sort_by("vec_id").to_pandas()
    v = np.stack(e["embedding"]).astype(float)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    scores, label = np.round(v @ v.T, 6), e["label"].to_numpy()
    np.fill_diagonal(scores, -9)
    same = label[np.argsort(-scores, axis=1, kind="stable")[:, :10]] == label[:, None]
    got = {r["label"]: r for r in entry.queries()["recall_at_k"](spark, SMALL).collect()}
    assert set(got) == set(label.tolist())
    for k, r in got.items():
        own = same[label == k]
        assert r["undetected"] == (~own.any(1)).sum()
        assert abs(r["recall_1"] - own[:, 0].mean()) < 1e-6 and abs(r["recall_3"] - own[:, :3].any(1).mean()) < 1e-6


def test_equal_scores_pass_on_only_the_first(spark):
    scores = np.zeros((2, 900), np.float32)
    scores[1, 899] = 1
    i, j = R._nearly_best(scores, 3, 1e-6)
    assert (i == 0).sum() == 900 and (1, 899) in set(zip(i.tolist(), j.tolist()))
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(500)] + [(900, [0.0, 1.0])], "id long, v array<double>")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in R.cosine_top(df.where("id >= 499"), df, "id", "id", "v", 2).collect())
    assert got == [(499, 1, 0), (499, 2, 1), (900, 1, 900), (900, 2, 0)]
