import json
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from concord.plans.compare import compare_facts, search_candidates
from concord.plans.report import fact_report
from concord.sources.office import read_office
from concord.sources.staged import cached_or_compute
from concord.streaming import progress as P

EVENTS = [
    {"ev": "plan", "seq": 1, "ts": 1.0, "units": ["a", "b"]},
    {"ev": "unit_start", "seq": 2, "ts": 2.0, "key": "a", "parts": 2},
    {"ev": "part", "seq": 3, "ts": 3.0, "key": "a", "index": 2},
    {"ev": "step", "seq": 4, "ts": 4.0, "key": "a", "done": 1, "total": 2},
    {"ev": "part", "seq": 5, "ts": 5.0, "key": "a", "index": 1},
    {"ev": "unit_done", "seq": 6, "ts": 6.0, "key": "a"},
    {"ev": "unit_start", "seq": 7, "ts": 7.0, "key": "a"},
    {"ev": "step", "seq": 8, "ts": 8.0, "key": "zzz", "done": 9, "total": 1},
    {"ev": "finish_remaining", "seq": 9, "ts": 9.0},
]


def test_progress_never_falls_and_batch_equals_steps(spark):
    state, seen = P.new_state(), []
    for e in EVENTS:
        P.advance(state, e)
        seen.append(state["peak"])
    assert seen == sorted(seen) and seen[3] == 0.375 and seen[-1] == 1.0
    lines = spark.createDataFrame([("j", json.dumps(e)) for e in EVENTS] + [("j", "{broken")], "job string, value string")
    assert P.fold_batch(P.read_events(lines)).first().asDict() == P.snapshot("j", state)


def test_progress_stream_ends_where_the_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((EVENTS[:4], EVENTS[4:])):
        (source / f"{k}.jsonl").write_text("".join(json.dumps({"job": "j", "line": json.dumps(e)}) + "\n" for e in part))
        os.utime(source / f"{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))  # the order of the batches
    lines = spark.readStream.schema("job string, line string").option("maxFilesPerTrigger", 1).json(str(source)).select("job", F.col("line").alias("value"))
    out = []
    query = P.fold_stream(P.read_events(lines)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: out.extend(r.asDict() for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    state = P.new_state()
    for e in EVENTS:
        P.advance(state, e)
    assert out[-1] == P.snapshot("j", state)


def _zip(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('A', '<w:vMerge w:val=\"restart\"/>')}{cell('B', '<w:gridSpan w:val=\"2\"/>')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('C')}{cell('D')}</w:tr><w:tr>{cell('E')}{cell('F', '<w:vMerge/>')}{cell('G')}</w:tr></w:tbl>"
    _zip(tmp_path / "a.docx", word__document_xml=f"<w:document {w}><w:body><w:p/><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top</w:t><w:tab/><w:t>x</w:t></w:r></w:p>{table}</w:body></w:document>")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    _zip(tmp_path / "b.xlsx", xl__sharedStrings_xml=f"<sst {s}><si><t>Name</t></si></sst>", xl__worksheets__sheet1_xml=f"<worksheet {s}><sheetData><row><c r='B2' t='s'><v>0</v></c><c r='AA3'><v>1.5</v></c></row></sheetData></worksheet>")
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    _zip(tmp_path / "c.pptx", ppt__slides__slide2_xml=f"<p:sld {ns}><p:sp><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sp><p:sp/></p:sld>")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = read_office(spark, str(tmp_path)).collect()
    by = {d: [r for r in rows if r["doc"] == d] for d in ("a.docx", "b.xlsx", "c.pptx", "d.docx", "~$a.docx")}
    assert [(r["block_id"], r["style"], r["text"]) for r in by["a.docx"][:1]] == [("w_b001", "Heading1", "Top x")]
    assert [(r["row"], r["col"], r["text"]) for r in by["a.docx"][1:]] == [(0, 0, "A"), (0, 1, "B"), (0, 2, "B"), (1, 0, "A"), (1, 1, "C"), (1, 2, "D"), (2, 0, "E"), (2, 1, ""), (2, 2, "G")]
    assert [(r["row"], r["col"], r["text"]) for r in by["b.xlsx"]] == [(2, 2, "Name"), (3, 27, "1.5")]
    assert [(r["block_id"], r["text"]) for r in by["c.pptx"]] == [("p002_s001", "Hello")]
    assert by["d.docx"][0]["error"] and not by["~$a.docx"]


def test_stage_computes_only_what_is_new(spark, tmp_path):
    path, seen = str(tmp_path / "stage"), []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("n", F.length("text"))

    a = spark.createDataFrame([("x",), ("x",), ("yy",)], "text string")
    b = spark.createDataFrame([("yy",), ("zzz",)], "text string")
    assert sorted(r["n"] for r in cached_or_compute(a, ["text"], path, compute).collect()) == [1, 1, 2]
    assert sorted(r["n"] for r in cached_or_compute(b, ["text"], path, compute).collect()) == [2, 3] and seen == [2, 1]
    c = spark.createDataFrame([(None,), ("",), ("",)], "text string")
    assert [r["n"] for r in cached_or_compute(c, ["text"], path, compute).orderBy("n").collect()] == [None, 0, 0] and seen[-1] == 2


def test_plans(spark):
    queries = spark.createDataFrame([(1, "rated voltage 3.7")], "query_id int, text string")
    target = spark.createDataFrame([("i1", "t", "the rated voltage is 3.7 volts"), ("i2", "t", "colour black")], "item_id string, doc_id string, text string")
    assert search_candidates(queries, [target]).orderBy("rank").first()["item_id"] == "i1"
    schema = "doc string, fact_id string, entity_name string, attributes map<string,struct<value:string,unit:string>>, evidence_text string, pos long"
    ref = spark.createDataFrame(pd.DataFrame([("r", "f1", "Rated Voltage", {"target_value": ("3.7", "v")}, "e", 0), ("r", "f2", "Gone", {}, "e", 1)], columns=["doc", "fact_id", "entity_name", "attributes", "evidence_text", "pos"]).values.tolist(), schema)
    tgt = spark.createDataFrame([("t", "g1", "rated voltage", {"target_value": ("3.8", "v")}, "ev", 0)], schema)
    got = {r["fact_id"]: (r["result"], r["mismatch_attributes"], r["triggers"]) for r in compare_facts(ref, tgt).collect()}
    assert got == {"f1": ("mismatch", "target_value", ["code_mismatch"]), "f2": ("missing", "", ["code_missing"])}
    assert fact_report(compare_facts(ref, tgt)).first()["line"].startswith("| mismatch |")
