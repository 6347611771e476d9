"""Judged answers, validation, records and artifacts on small tables."""

from pyspark.sql import functions as F

from concord.functions import labels as L
from concord.operators import grid as G
from concord.operators import judging as J
from concord.operators import scoring as S
from concord.operators import validation as C
from concord.sources import artifacts as A

ATTR = "map<string,struct<value:string,unit:string>>"


def test_judged_facts_keep_only_candidates(spark):
    answers = spark.createDataFrame([(1, "ok", "MATCH "), (2, "ok", "match"), (3, "ok", "missing"), (4, "length", "match"), (5, "ok", None), (6, "ok", "match")], "k long, status string, result string")
    candidates = spark.createDataFrame([(k, i) for k in range(1, 7) for i in (10, 11)], "k long, fact_id long")
    findings = spark.createDataFrame([(1, 10, "match", ["a"], 1), (1, 11, "mismatch", ["b", "a"], 2), (2, 99, "match", None, 1), (3, 10, "match", None, 1), (4, 10, "match", None, 1), (6, 10, "match", None, 1), (6, 99, "match", None, 2)], "k long, fact_id long, result string, mismatch_attributes array<string>, pos long")
    got = {r["k"]: (r["result"], r["target_id"], r["mismatch_attributes"], r["n_dropped"], r["failure_reason"], r["decided_by"]) for r in J.judge_facts(answers, candidates, findings, "k").collect()}
    assert got == {
        1: ("match", 11, "a,b", 0, "", "model"),
        2: ("unknown", None, "", 1, "", "model"),
        3: ("missing", None, "", 0, "", "model"),
        4: ("unknown", None, "", 0, "output_truncated", "code"),
        5: ("unknown", None, "", 0, "", "model"),
        6: ("match", 10, "", 1, "", "model"),
    }


def test_judged_items_and_pairs_without_answers(spark):
    items = spark.sql("select id item_id from range(3)")
    candidates = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, candidate_id string")
    answers = spark.createDataFrame([(0, "same", ["a"]), (1, "nonsense", ["a", "x", "a"])], "item_id long, verdict string, matched_ids array<string>")
    got = {r["item_id"]: (r["verdict"], r["matched_ids"]) for r in J.judge_items(items, candidates, answers, "item_id").collect()}
    assert got == {0: ("not_found", []), 1: ("different", ["a", "a"]), 2: ("different", [])}
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "left_id long, right_id long")
    said = spark.createDataFrame([(1, 2, "differs_by", "size", 1), (8, 9, "same_as", "", 2)], "left_id long, right_id long, relation string, axis string, pos long")
    assert {tuple(r)[:5] for r in J.judge_pairs(pairs, said).collect()} == {(1, 2, "differs_by", "size", "model"), (3, 4, "unknown", "", "")}


def test_batch_pieces_are_those_of_halving(spark):
    def halve(items, depth):
        if len(items) <= 2 or depth == 0:
            return [items]
        middle = len(items) // 2
        return halve(items[:middle], depth - 1) + halve(items[middle:], depth - 1)

    for n in (1, 2, 7, 30, 31):
        rows = spark.range(n).select(F.lit(n).alias("size"), F.col("id").alias("place"))
        start, length = J.split_batch("size", "place", 3, 2)
        got = sorted({(r["s"], r["l"]) for r in rows.select(start.alias("s"), length.alias("l")).collect()})
        assert got == [(p[0], len(p)) for p in halve(list(range(n)), 3)]


def test_validation_of_facts(spark):
    facts = spark.createDataFrame(
        [("d", 1, "alpha beta", {"x": ("5", "mm")}, "word", None, ["b1", "b9"], None, None), ("d", 2, "alpha gamma delta", {"x": ("5", "mm")}, "excel", 7, None, None, None), ("d", 3, " ", {"x": ("5", "mm")}, "ppt", None, None, 4, ["s1"]),
         ("d", 4, None, {}, None, None, None, None, None), ("d", 5, "...", {"x": ("a", "")}, "ppt", None, None, 2, ["s9"]), ("e", 6, "alpha", {"x": ("a", "")}, "excel", 7, None, None, None)],
        f"doc string, fact_id long, evidence_text string, attributes {ATTR}, doc_type string, row int, block_ids array<string>, slide_no int, shape_ids array<string>")
    texts = spark.createDataFrame([("d", "Alpha"), ("d", "beta again"), ("d", None)], "doc string, text string")
    places = spark.createDataFrame([("d", "row", "1"), ("d", "block", "b1"), ("d", "slide", "2"), ("d", "shape", "s1")], "doc string, kind string, locator string")
    checks = C.validate_facts(facts, texts, places)
    got = {(r["fact_id"], r["check_name"], r["reason"]) for r in checks.where("severity = 'error'").collect()}
    assert got == {(2, "evidence_missing", "0.3333: delta gamma"), (3, "evidence_missing", "empty"), (6, "evidence_missing", "0.0: alpha"), (1, "source_unresolvable", "block b9"), (2, "source_unresolvable", "row 7"), (3, "source_unresolvable", "slide 4"), (5, "source_unresolvable", "shape s9")}
    assert {r["fact_id"] for r in C.low_confidence(checks).collect()} == {1, 2, 3, 5, 6}
    assert (4, "no_attributes") in {(r["fact_id"], r["check_name"]) for r in checks.collect()}
    assert C.validate_facts(facts.limit(0), texts, places).count() == 0


def test_covering_facts_against_all_pairs(spark):
    import random

    random.seed(5)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    golden = [(k, " ".join(random.sample(words, random.randint(0, 6)))) for k in range(20)]
    facts = [(k, " ".join(random.sample(words, random.randint(0, 8)))) for k in range(60)]
    got = S.covering_facts(spark.createDataFrame(golden, "golden_id long, golden_text string"), spark.createDataFrame(facts, "fact_id long, fact_text string"), 0.6)
    want = {(g, f) for g, a in golden if a for f, b in facts if len(set(a.split()) & set(b.split())) / len(set(a.split())) >= 0.6}
    assert {(r["golden_id"], r["fact_id"]) for r in got.collect()} == want


def test_records_of_rows(spark):
    cells = spark.createDataFrame([("d", "s", 2, 1, "k"), ("d", "s", 2, 2, " 5 "), ("d", "s", 2, 3, "x"), ("d", "s", 3, 1, " "), ("d", "s", 4, 2, "7")], "doc string, sheet string, row int, col int, value string")
    headers = spark.createDataFrame([("d", "s", 1, "Item"), ("d", "s", 2, "Size")], "doc string, sheet string, col int, header string")
    records = G.build_records(cells, headers, headers.where("col = 1"))
    got = {r["row"]: r for r in records.collect()}
    assert set(got) == {2, 4}
    assert (got[2]["text"], got[2]["key_context"], got[2]["label"]) == ("Item=k | Size=5 | col3=x", "[Item=k]", "d > [s] 2 [Item=k]")
    assert {r["item_id"]: r["text"] for r in G.split_records(records).collect()} == {"d#s!B2": "[Item=k] Size=5", "d#s!C2": "[Item=k] col3=x", "d#s!B4": "Size=7"}


def test_named_map_keeps_the_last(spark):
    row = spark.sql("select array(named_struct('name', 'a', 'value', '1', 'unit', ''), named_struct('name', ' ', 'value', '2', 'unit', ''), named_struct('name', 'a ', 'value', '3', 'unit', 'm')) items, cast(null as map<string,struct<value:string,unit:string>>) none")
    assert row.select(L.attributes_text(L.named_map("items")).alias("x"), L.attributes_text("none").alias("y")).first() == ("a=3m", "-")


def test_artifacts_replace_one_document(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    A.save_artifact(rows(1, 2), root, "facts", "r1", "a")
    A.save_artifact(rows(3), root, "facts", "r1", "b")
    A.save_artifact(rows(4), root, "facts", "r1", "a")
    assert sorted((r["doc"], r["x"]) for r in A.load_artifact(spark, root, "facts").collect()) == [("a", 4), ("b", 3)]


def test_notes_and_labelled_lines(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "b.md").write_text("hello\nthere")
    (tmp_path / "n" / "c.txt").write_text("other")
    assert [tuple(r) for r in A.read_notes(spark, str(tmp_path / "n"), 6).collect()] == [("b.md", "hello\n\n…")]
    (tmp_path / "g.jsonl").write_text('{"row": "1", "expected": "match"}\nbroken\n')
    got = A.read_labelled(spark, str(tmp_path / "g.jsonl")).cache()
    assert sorted((r["row"] or "", r["broken"] or "") for r in got.collect()) == [("", "broken"), ("1", "")]
