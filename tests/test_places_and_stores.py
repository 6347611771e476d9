"""Places of facts, published runs, reports and the cache of vectors."""

import json

import pytest
from pyspark.sql import functions as F

from concord.operators import places as P
from concord.sources import store
from concord.sources.staged import cached_or_compute
from concord.sources.vector_cache import cache_stats, with_vectors


def test_ranges_and_the_cells_in_them(spark):
    asked = ["B2", "$B$2:D9", "d9:b2", "7", "3:4", "", None, "2B", "B2:", "ABCD1", "A1:B"]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "k int, a string").select("k", P.range_bounds("a").alias("r"))
    got = {r["k"]: None if r["r"] is None else tuple(r["r"]) for r in df.collect()}
    assert got == {0: (2, 2, 2, 2), 1: (2, 2, 9, 4), 2: (2, 2, 9, 4), 3: (7, 1, 7, 16384), 4: (3, 1, 4, 16384), 5: None, 6: None, 7: None, 8: None, 9: None, 10: None}
    cells = spark.createDataFrame([("d", "s", r, c) for r in (1, 2, 63, 64, 65, 200) for c in (1, 2, 3)] + [("d", "t", 2, 2), (None, None, 2, 2)], "doc string, sheet string, row int, col int")
    claims = spark.createDataFrame([("d", "s", 1, "B2:C65"), ("d", "s", 2, "A1"), ("d", "s", 3, "nowhere"), ("d", "x", 4, "A1"), ("d", "s", 5, "64")], "doc string, sheet string, fact_id long, cell_range string")
    for band in (1, 64, 1000):
        cited = P.cited_cells(claims, cells, band)
        assert {(r["fact_id"], r["row"], r["col"]) for r in cited.collect()} == {(1, r, c) for r in (2, 63, 64, 65) for c in (2, 3)} | {(2, 1, 1)} | {(5, 64, c) for c in (1, 2, 3)}
    shown = {(r["doc"], r["sheet"]): (r["n_cells"], r["n_cited"], r["n_uncited_rows"]) for r in P.cell_coverage(cells.where("doc is not null"), cited).collect()}
    assert shown == {("d", "s"): (18, 10, 1), ("d", "t"): (1, 0, 1)}


def test_sources_keep_what_exists(spark):
    claims = spark.createDataFrame([("d", 1, ["b2", "zz", "b1", "b2"]), ("d", 2, ["zz"]), ("d", 3, []), ("d", 4, None), ("e", 5, ["b1"])], "doc string, fact_id long, block_ids array<string>")
    blocks = spark.createDataFrame([("d", "b1"), ("d", "b2"), ("d", "b2")], "doc string, block_id string")
    got = {r["fact_id"]: (r["block_ids"], r["lost"], r["orphan"]) for r in P.rebuild_sources(claims, ["fact_id"], "block_ids", blocks.withColumnRenamed("block_id", "id")).collect()}
    assert got == {1: (["b2", "b1", "b2"], ["zz"], False), 2: ([], ["zz"], True), 3: ([], [], True), 4: ([], [], True), 5: ([], ["b1"], True)}
    assert {r["fact_id"] for r in P.facts_without_block(claims, blocks).collect()} == {2, 3, 4, 5}


def test_lines_units_and_compact_documents(spark):
    text = spark.createDataFrame([("d", "b1", "one\n\n   two \r\nthree", 0), ("d", "b2", "alone", 0), ("d", "b3", "in", 2), ("d", "b4", None, 3), ("d", "b5", " \n ", 0)], "doc string, block_id string, t string, i int")
    assert [tuple(r)[2:] for r in P.line_index(text, "t", "i").orderBy("line_id").collect()] == [("b1:l01", 1, "one", 0), ("b1:l02", 2, "two", 3), ("b1:l03", 3, "three", 0), ("b3:l01", 1, "in", 2)]
    rows = [("s", "ppt", 2, 1, "p2a", "text", "", "Title", "x", None), ("s", "ppt", 1, 2, "p1b", "table", None, "", None, [["a", "b"]]), ("s", "ppt", 1, 1, "p1a", "text", "H1", None, "é \"q\"", None), ("w", "word", 1, 1, "w1", "text", None, None, " ", None), ("w", "word", 1, 2, "w2", "text", None, None, "z", None)]
    blocks = spark.createDataFrame(rows, "doc string, doc_type string, container int, ord int, block_id string, kind string, style string, name string, text string, rows array<array<string>>")
    assert sorted((r["doc"], r["blocks"]) for r in P.units(blocks).collect()) == [("s", ["p1a", "p1b"]), ("s", ["p2a"]), ("w", ["w1"]), ("w", ["w2"])]
    got = {r["doc"]: json.loads(r["json"]) for r in P.compact_blocks(blocks).collect()}
    assert got["s"]["blocks"] == [{"id": "p1a", "type": "text", "text": "é \"q\"", "style": "H1"}, {"id": "p1b", "type": "table", "rows": [["a", "b"]]}, {"id": "p2a", "type": "text", "text": "x", "name": "Title"}]
    assert {r["doc"]: r["text"] for r in P.all_texts(blocks).collect()} == {"s": "é \"q\"\nx", "w": "z"}


def test_a_run_is_visible_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert store.list_runs(spark, root) == [] and store.manifest(spark, root, "r1") == {}
    store.publish(spark, root, "r1", {"facts": table(1, 2)}, {"stages": {"a": 1, "b": 2}, "kept": 5})
    store.publish(spark, root, "r2", {"other": table(9)})
    with monkeypatch.context() as broken:  # a crash between writing and publishing
        broken.setattr(store, "_write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            store.publish(spark, root, "r1", {"facts": table(7)})
    assert sorted(r["v"] for r in store.read_table(spark, root, "r1", "facts").collect()) == [1, 2]
    store.publish(spark, root, "r1", {"edges": table(3)}, {"stages": {"b": 4}, "new": 1})
    assert store.exists(spark, root, "r1", "facts") and store.exists(spark, root, "r1", "edges") and not store.exists(spark, root, "r2", "facts")
    assert store.manifest(spark, root, "r1")["stats"] == {"stages": {"a": 1, "b": 4}, "kept": 5, "new": 1}
    (tmp_path / "runs" / "_timeline").mkdir()
    (tmp_path / "runs" / "unpublished").mkdir()
    assert store.list_runs(spark, root) == ["r1", "r2"] and store.list_runs(spark, root, "other") == ["r2"]


def test_reports_are_saved_listed_and_read(spark, tmp_path):
    root = str(tmp_path / "reports")
    lines = spark.createDataFrame([(2, "second"), (1, "# première")], "ord int, line string")
    assert store.list_reports(spark, root) == []
    path = store.save_report(spark, lines, root, "a")
    store.save_report(spark, lines.limit(1), root, "b.md")
    store.save_report(spark, lines.where("ord = 1"), root, "a")
    assert path in store.list_reports(spark, root) and {r["name"]: r["text"] for r in store.read_reports(spark, root).collect()}["a.md"] == "# première"


def test_vectors_are_made_once(spark, tmp_path):
    path, asked = str(tmp_path / "vectors"), []

    def embed(df):
        asked.append(sorted(r["text"] for r in df.collect()))
        return df.withColumn("vector", F.when(F.col("text") != "bad", F.array(F.length("text").cast("double"))))

    items = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, "bad"), (6, "")], "id int, text string")
    first = with_vectors(items, path, "m", "passage", embed)
    assert {r["id"]: r["vector"] for r in first.collect()} == {1: [2.0], 2: [3.0], 3: [2.0], 4: None, 5: None, 6: [0.0]}
    assert asked == [["", "aa", "bad", "bbb"]] and cache_stats(first).first() == (5, 0, 5)
    again = with_vectors(items.unionByName(spark.createDataFrame([(7, "new")], items.schema)), path, "m", "passage", embed)
    assert {r["id"]: r["cached"] for r in again.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False} and asked[1] == ["bad", "new"]
    with_vectors(items, path, "m", "query", embed)
    assert asked[2] == ["", "aa", "bad", "bbb"]  # another kind is another vector
    done = with_vectors(items.where("id < 4"), path, "m", "passage", embed)
    assert asked[3] == [] and cache_stats(done).first() == (3, 3, 0)


def test_inputs_without_a_result_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    got = cached_or_compute(rows, ["t"], str(tmp_path / "c"), lambda df: df.where("t = 'a'").select("digest", F.lit(5).alias("v"))).collect()
    assert {(r["id"], r["v"]) for r in got} == {(1, 5), (2, None)}
