"""What a row costs: values, words and comparisons are evaluated once, however often rules name them."""

from pyspark.sql import functions as F

from concord.functions.text import once
from concord.operators import facts as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def compared(spark, rows):
    df = spark.createDataFrame(rows, "fact_id long, a string, u string, b string, v string")
    one = lambda x, y: F.map_from_arrays(F.array(F.lit("k")), F.array(F.struct(F.col(x).alias("value"), F.col(y).alias("unit"))))
    return V.compare(df.select("fact_id", one("a", "u").alias("attributes"), F.when(F.col("fact_id") >= 0, F.struct(one("b", "v").alias("attributes"))).alias("target")))


def test_attributes_are_read_once(spark):
    """A row of a filtered comparison takes few patterns, whatever the rules name; results stay."""
    rows = [(1, "5", "", "5.0", "v"), (2, "5", "", "50", ""), (3, "5", "v", "50", "mA"), (4, "5", "v", "50", "V"), (5, "a b", "", "AB", ""), (6, "a", "", "b", ""), (7, "1,000", "?", "1000", ""), (8, "0", "", "0.0", ""), (9, "0", "", "5", None), (10, None, "", "5", ""), (-1, "5", "", "5", "")]
    got = compared(spark, rows)
    assert {r["fact_id"]: r["code_result"] for r in got.collect()} == {1: "match", 2: None, 3: None, 4: "mismatch", 5: "match", 6: None, 7: None, 8: "match", 9: "mismatch", 10: None, -1: "missing"}
    assert {r["fact_id"]: r["mismatch_attributes"] for r in got.where("result = 'mismatch'").collect()} == {4: "k", 9: "k"}
    assert plan(got.where("result <> 'match'").select("fact_id")).count("RLIKE") <= 8
    assert spark.range(3).select(once(F.col("id") + 1, lambda x: x * x).alias("n")).agg(F.sum("n")).first()[0] == 14
