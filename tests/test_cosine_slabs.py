"""Nearest vectors do not depend on how many scores a task holds at once."""

import random

from concord.operators import retrieval as R


def test_few_scores_at_once_give_the_same(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)], "id long, v array<double>")
    rows = lambda n: sorted(tuple(r) for r in R.cosine_top(df.where("id % 4 = 0"), df, "id", "id", "v", 3, scores_held=n).collect())
    assert rows(1) == rows(130) == rows(R.SCORES) and len(rows(1)) == 45
