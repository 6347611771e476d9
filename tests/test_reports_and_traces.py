"""Details of reports, traces of missing comparisons, places in words, hints and notes."""

from pyspark.sql import functions as F

from concord.functions.labels import place_text
from concord.operators import runs as U
from concord.operators import trace as R
from concord.plans.report import fact_details, field_rows, item_report

A = "map<string,struct<value:string,unit:string>>"


def test_places_in_words(spark):
    df = spark.createDataFrame([("excel", "S", "", None, None, [], 7, None), ("excel", "", "", None, None, [], 7, None), ("excel", "S", "B2", None, None, [], 7, None), ("excel", "S", None, None, None, [], None, None), ("ppt", None, None, None, 3, ["a"], None, True), ("ppt", None, None, None, None, [], None, True), ("pdf", None, None, None, None, [], None, None)], "t string, s string, w string, b array<string>, n int, h array<string>, r int, o boolean")
    got = [r[0] for r in df.select(place_text("t", F.col("s"), F.col("w"), F.col("b"), F.col("n"), F.col("h"), F.col("r"), F.col("o"))).collect()]
    assert got == ["S!행 7", "행 7", "S!B2", "S", "슬라이드 3 / 도형 a / 스피커노트 포함", "스피커노트 포함", "-"]


def test_details_of_facts(spark):
    rows = [(1, "a", "Size", "match", "", "code", {"w": ("1", "mm")}, "size 1 mm", ({"w": ("1", "mm")}, "1 mm wide")), (2, "a", "Age", "mismatch", "years", "", {}, "", None)]
    compared = spark.createDataFrame(rows, f"fact_id long, target_doc string, entity_name string, result string, mismatch_attributes string, decided_by string, attributes {A}, evidence_text string, target struct<attributes:{A},evidence_text:string>")
    findings = spark.createDataFrame([(1, "a", 1, "match", "1 mm", True, "x  y"), (1, "a", 2, "unknown", "", False, ""), (2, "a", 1, "match", "q", True, "")], "fact_id long, target_doc string, pos int, result string, quote string, verified boolean, reason string")
    lines = [r["line"] for r in fact_details(compared, F.lit("S!A1"), F.lit("-"), findings).orderBy("n", "k").collect()]
    assert lines == ["### 1. Age - mismatch (years)", "", "| | values | quote | place |", "|---|---|---|---|", "| reference | - | - | S!A1 |", "| a | - | (no counterpart) | - |", "<sub>decided by nobody</sub>",
                     "### 2. Size - match", "", "| | values | quote | place |", "|---|---|---|---|", "| reference | w=1 mm | size 1 mm | S!A1 |", "| a | w=1 mm | 1 mm wide | - |", "<sub>decided by code</sub>", '- match: x y - "1 mm"', "- unknown (quote not found)"]


def test_items_with_findings(spark):
    results = spark.createDataFrame([(1, 5, "row 1", "A | B", "partial", "", None, [])], "item_id long, pos int, label string, text string, verdict string, reasoning string, matched_ids array<string>, sources array<string>")
    cands = spark.createDataFrame([], "item_id long, candidate_id string, rank int, score double, label string, text string")
    findings = spark.createDataFrame([(1, 1, "h", "v", True, "n", "e"), (1, 2, "g", "", False, "", "")], "item_id long, pos int, header string, value string, found boolean, note string, evidence string")
    lines = [r["line"] for r in item_report(results, cands, findings).orderBy("section", "n", "k").collect()]
    assert "| 1 | A \\| B | partial | - | 1/2 fields found |" in lines and "| h | v | found | n | e |" in lines and "| g | | absent | | - |" in [x.replace("|  |", "| |") for x in lines]
    assert [tuple(r) for r in field_rows(findings).orderBy("pos").collect()] == [(1, 1, "h", "v", "found", "n", "e"), (1, 2, "g", "", "absent", "", "-")]


def test_every_cause_of_a_trace(spark):
    names = ["f5", "gate", "undecided", "blocked", "promoted", "nothing", "mention", "unsaved", "empty", "kept", "cut", "low"]
    verdicts = spark.createDataFrame([(k, "e" if n == "nothing" else "d", n, "missing", "model" if n == "f5" else "code") for k, n in enumerate(names)] + [(99, "d", "found", "match", "code")], "fact_id long, target_doc string, entity_name string, result string, decided_by string")
    edge = lambda k, no, relation, rejected="", axis="", promoted=False, reason="": (k, "d", 100 + no, relation, axis, "model", rejected, promoted, reason, 0.5, no)
    edges = [edge(0, 1, "differs_by"), edge(1, 2, "differs_by", axis="z"), edge(1, 3, "unknown", "evidence"), edge(2, 4, "unknown", reason="no answer for this pair"), edge(3, 5, "differs_by", axis="b"), edge(3, 6, "same_as"), edge(4, 7, "differs_by", axis="b"), edge(4, 8, "differs_by", axis="p", promoted=True), edge(99, 9, "differs_by")]
    edges = spark.createDataFrame(edges, "ref_id long, target_doc string, target_id long, relation string, axis string, decided_by string, rejected_by string, promoted boolean, reason string, score double, edge_no long")
    ranked = spark.createDataFrame([(9, "d", 1, 0.9, 1, ""), (10, "d", 1, 0.9, 1, "top_k"), (11, "d", 1, 0.1, 1, "min_score"), (6, "d", 1, 0.1, 1, "min_score")], "ref_id long, target_doc string, target_id long, score double, rank int, cut_by string")
    cited = spark.createDataFrame([("d", 5)], "doc string, n_cited long")
    said = spark.createDataFrame([("d", "mention")], "doc string, entity_name string")
    found = R.trace_missing(verdicts, edges, ranked, cited, said)
    got = {r["entity_name"]: (r["cause"], r["subcause"], r["confidence"], len(r["edges"])) for r in found.collect()}
    assert got == {
        "f5": ("f5_llm", "", "confirmed", 1), "gate": ("evidence_gate", "evidence", "confirmed", 2), "undecided": ("llm_undecided", "absent", "confirmed", 1), "blocked": ("blocked", "b", "inferred", 1),
        "promoted": ("blocked", "p", "confirmed", 2), "nothing": ("extraction", "no_block", "confirmed", 0), "mention": ("extraction", "mentioned", "inferred", 0), "unsaved": ("unresolved", "", "unresolved", 0),
        "empty": ("unresolved", "", "unresolved", 0), "kept": ("recall", "no_edge", "inferred", 0), "cut": ("recall", "top_k", "confirmed", 0), "low": ("recall", "min_score", "confirmed", 0),
    }
    trail = {r["entity_name"]: [(s["stage"], s["ok"]) for s in r["trail"]] for r in found.collect()}
    assert trail["gate"] == [("recall", True), ("judgement", True), ("gate", False), ("comparison", False)] and trail["kept"][1] == ("recall", False)
    assert {r["cause"]: r["n"] for r in R.cause_histogram(found).collect()} == {"f5_llm": 1, "evidence_gate": 1, "llm_undecided": 1, "blocked": 2, "extraction": 2, "recall": 3, "unresolved": 2}
    assert R.trace_missing(verdicts, edges, None, cited).where("cause = 'unresolved'").count() == 6


def test_hints_notes_and_filters(spark):
    cells = spark.createDataFrame([("d", "s", r, 1, v) for r, v in [(1, "Unit"), (1, " "), (2, "Unit"), (3, "unit"), (40, "Value")]], "doc string, sheet string, row int, col int, value string")
    assert {r["text"] for r in U.role_hints(cells, 2).collect()} == {"Unit"} and "unit" in {r["text"] for r in U.role_hints(cells).collect()}
    notes = spark.createDataFrame([("b.md", "two "), ("a.md", "\none"), ("c.md", "  ")], "name string, text string")
    assert U.knowledge_text(notes).first()["text"] == "## [a.md]\none\n\n## [b.md]\ntwo" and U.knowledge_text(notes, 12).first()["text"] == "## [a.md]\non\n…"
    assert spark.range(1).select(U.knowledge_block(F.lit(" x\n"), "Notes", "--").alias("t"), U.knowledge_block(F.lit(" "), "n").alias("e")).first() == ("Notes\n--\nx\n--\n", "")
    rows = spark.createDataFrame([("a", "match", "Big Size", 1.0, "ok"), ("b", "match", "size", 9.0, "error"), ("b", "missing", "Age", 5.0, "ok")], "target_doc string, result string, entity_name string, seconds double, status string")
    kept = lambda **k: sorted(r["entity_name"] for r in U.kept_comparisons(rows, **k).collect())
    assert kept(name="SIZE") == ["Big Size", "size"] and kept(target_doc="b", result="missing") == ["Age"] and kept(slow=5.0) == ["Age", "size"] and kept(errors_only=True) == ["size"] and len(kept()) == 3
