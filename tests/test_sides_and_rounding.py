"""Graphs whose two sides use equal numbers, and decimals that lie between two roundings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.functions.numbers import fixed
from concord.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    """Parts whose keys reach those of the suppliers, with edges either way between equal numbers."""
    folder = str(tmp_path_factory.mktemp("keys"))
    part = [(k, f"p{k}", "b", k % 50) for k in (5, 7, 1_000_001, 1_000_002, 1_000_003, 1_000_105)]
    line = []
    for n, (p, s) in enumerate([(1_000_002, 1), (1_000_001, 2), (1_000_003, 3), (1_000_105, 1), (1_000_001, 105), (1_000_001, 105), (5, 5), (9, 1), (1_000_004, 2), (1_000_002, 1_000_005 - 1_000_000)] * 2):
        line.append((n + 1, p, s, n % 7 + 1, float(n % 50), 0.06, "RA"[(n + n // 10) % 2], "OF"[n % 2]))
    supplier = [(s, s % 25) for s in (1, 2, 3, 4, 5)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(supplier, "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def by_sql(folder, name, columns):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()))


@pytest.mark.parametrize("name", ["blocked_by", "contradictions", "dangling_edges", "edge_lookup", "graph_checks"])
def test_sides_with_equal_numbers_stay_apart(spark, large_keys, name):
    got = QUERIES[name](spark, large_keys)
    assert sorted(repr(tuple(r)) for r in got.collect()) == by_sql(large_keys, name, got.columns)


def test_fixed_rounds_as_printf(spark):
    values = [0.2975, 0.2985, 0.0625, 0.1875, 0.1235, 0.0005, 0.0015, 0.9995, 0.99949999999999994, 1.0005, 2.5, 0.0, -0.0625, -1.2345, 123456.7895, 0.1 + 0.2, 1e-9, 999999999.9995, 1e15, None]
    values += [k / 1_000_000 for k in range(500, 600_000, 1000)]
    for places in (1, 3, 6):
        rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed("x", places).alias("t")).collect()
        assert [r["t"] for r in rows] == [None if v is None else f"{v:.{places}f}" for v in values]
    assert spark.range(1).select(F.lit(0.297500).alias("x")).select(fixed("x", 3)).first()[0] == f"{0.2975:.3f}"
