import unicodedata

from pyspark.sql import functions as F

from concord.functions import numbers as N
from concord.functions import text as X
from concord.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_tokens_with_hangul_bigrams(spark):
    r = one(spark, a=X.tokens(F.lit("Max 1,200.5 mA 영업이익 전압")), b=X.tokens(F.lit(None).cast("string")))
    assert r["a"] == ["max", "1,200.5", "ma", "영업이익", "영업", "업이", "이익", "전압"] and r["b"] == []


def test_normalize_value(spark):
    cases = {"€ 7,250": "7250", "0.90 kg": "0.9kg", "35 만원": "35만원", " x \t y ": "x y", "-8.000": "-8", "": "", "+40": "+40", "1 2": "1 2", "9 volts": "9 volts"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", X.normalize_value("raw"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_columns_round_trip(spark):
    df = spark.range(1, 500000).select(X.column_letters("id").alias("c"), "id").withColumn("n", X.column_number("c"))
    assert df.where("n <> id").count() == 0 and df.where("id = 703").first()["c"] == "AAA" and df.where("id = 475255").first()["c"] == "AAAAA"
    assert one(spark, a=X.column_number(F.lit("A1")))["a"] == 1_000_000_000


def test_numbers_reject_what_is_no_number(spark):
    values = [("1,000", 1000.0), ("12d", None), ("nan", None), ("1_000", None), (" -2.5e3 ", -2500.0), (None, None), (".5", 0.5)]
    df = spark.createDataFrame(values, "t string, want double").withColumn("got", N.as_number("t"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_attribute_comparison_is_three_valued(spark):
    cases = [("3", "", "3.0", "v", True), ("3", "v", "4", "v", False), ("3", "v", "3", "kg", None), ("3", "a", "3", "v", None),
             ("1495", "", "1.495", "a", None), ("1495", "ma", "1.495", "ma", False), ("x y", "", "XY", "", True), ("x", "", "z", "", None), ("", "", "", "", None)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, au string, b string, bu string, want boolean")
    got = df.withColumn("got", N.compare_attribute(F.col("a"), F.col("au"), F.col("b"), F.col("bu"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_roles(spark):
    cases = {"Min. value": "quantitative_lower_bound", "nominal": "quantitative_target", "하한 치": "quantitative_lower_bound", "단위": "unit", "Item name": "entity_name", "": None, "zzz": None}
    df = spark.createDataFrame([(h, r) for h, r in cases.items()], "h string, want string").withColumn("got", X.guess_role("h"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_small_text_rules(spark):
    r = one(
        spark, d1=X.format_duration(F.lit(850)), d2=X.format_duration(F.lit(12_345)), d3=X.format_duration(F.lit(245_000)), t=X.truncate(F.lit("abcdef"), 4),
        e=X.classify_error(F.lit("TimeoutError"), F.lit("context length exceeded")), s=X.search_text(F.lit("a"), F.lit(" "), F.lit("a"), F.lit("b  c")),
        k=X.nfkc(F.lit("①ﬁ")), v=V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), f=X.fold(F.lit("x" * 50), 10, 10),
    )
    assert (r["d1"], r["d2"], r["d3"], r["t"], r["e"], r["s"], r["v"]) == ("850ms", "12.3s", "4m05s", "abc…", "length", "a b c", 0.0)
    assert r["k"] == unicodedata.normalize("NFKC", "①ﬁ") and "30" in r["f"]


def test_names_are_compared_in_compatibility_form(spark):
    names = {"Ｒａｔｅｄ １２": "rated12", "ﬁne ①": "fine1", "전 압": "전압", "\u1100\u1161": "가", "e\u0301x": "x", "A-b_C": "abc", "": ""}
    df = spark.createDataFrame(list(names.items()) + [(None, "")], "n string, want string").withColumn("got", X.norm_name("n"))
    assert all(r["got"] == r["want"] for r in df.collect())
