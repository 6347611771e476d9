"""Nested stages against a stack, names in texts against brute force, tails of growing files, silence in a stream against the batch."""

import json
import os
import random

from pyspark.sql import functions as F

from concord.operators import diagnose as D
from concord.operators import facts as V
from concord.operators import timelines as T
from concord.operators.containment import contained
from concord.sources.tail import LineTail, TailReader, complete_end
from concord.streaming.progress import watch_batch, watch_stream


def by_stack(events):
    open_, out, inside = [], {}, {}
    for k, (at, kind) in enumerate(events):
        if kind == "start":
            out[k] = [len(open_), open_[-1] if open_ else None, None]
            open_.append(k)
        elif kind == "end" and open_:
            begun = open_.pop()
            out[begun][2] = at - events[begun][0]
            if open_:
                inside[open_[-1]] = inside.get(open_[-1], 0) + out[begun][2]
    return {k: (d, p, s, None if s is None else s - inside.get(k, 0)) for k, (d, p, s) in out.items()}


def test_stages_nest_as_on_a_stack(spark):
    rng = random.Random(2)
    runs = {r: [(k // 2, rng.choice(["start", "end", "note"])) for k in range(rng.choice([1, 7, 60]))] for r in range(25)}
    rows = [(r, k, at, kind) for r, events in runs.items() for k, (at, kind) in enumerate(events)]
    events = spark.createDataFrame(rows, "run long, event_id long, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["run"], r["event_id"]): (r["depth"], r["parent_id"], r["seconds"], r["self_seconds"]) for r in T.nested_stages(events, "run", F.col("kind") == "start", F.col("kind") == "end").collect()}
    assert got == {(r, k): v for r, events in runs.items() for k, v in by_stack(events).items()}
    assert T.nested_stages(events.limit(0), "run", F.col("kind") == "start", F.col("kind") == "end").count() == 0


def test_symptoms_in_their_order_and_durations_of_documents(spark):
    rows = [("r", "llm_end", "length", True, 5, 3, None, True), ("r", "llm_end", "ok", False, 0, 0, None, None), ("r", "retry", "timeout", True, None, None, "JSON 파싱 실패", None), ("q", "llm_end", "ok", False, 7, 0, None, False)]
    events = spark.createDataFrame(rows, "run string, kind string, status string, failed boolean, output_chars int, reasoning_tokens int, reason string, slow boolean")
    assert [r["symptom"] for r in T.run_symptoms(events, "run").orderBy("ord").collect()] == ["timeout", "length", "reasoning", "empty_output", "parse", "slow"]
    stages = spark.createDataFrame([("extract a.docx", 1.5, "ok"), ("compare a.docx with b.xlsx", 2.0, "error"), ("other", 9.0, "ok")], "name string, seconds double, status string")
    got = T.document_durations(stages, spark.createDataFrame([("a.docx",), ("b.xlsx",), ("zz",)], "document string")).collect()
    assert {(r["document"], r["seconds"], r["failed"]) for r in got} == {("a.docx", 3.5, True), ("b.xlsx", 2.0, True)}


def test_names_in_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = {word(rng.choice([1, 2, 4, 9])) for _ in range(60)} | {"", None}
    texts = [(k, word(rng.choice([0, 3, 50])) if k % 9 else None) for k in range(90)] + [(3, "ab" * 50_000), (3, "ab" * 50_000)]
    df = spark.createDataFrame(texts, "name long, text string").withColumnRenamed("name", "key")
    want = sorted((k, n) for k, t in texts for n in names if t and n and n in t)
    for most in (10**6, 40):  # one automaton, and several in turns
        got = sorted((r["key"], r["name"]) for r in contained(df, F.col("text"), ["key"], spark.createDataFrame([(n,) for n in names], "name string"), most).collect())
        assert got == want
    assert contained(df, F.col("text"), ["key"], spark.createDataFrame([], "name string")).count() == 0


def test_mentions_and_covered_lines(spark):
    entities = spark.createDataFrame([("d", "Rated Power"), ("d", "Zz"), ("e", "Rated Power"), ("d", "")], "doc string, entity_name string")
    blocks = spark.createDataFrame([("d", 1, "the rated-power of it"), ("d", 2, "power alone"), ("d", 3, "nothing"), ("d", 4, "rated power, cited"), ("e", 1, "pow er")], "doc string, block int, block_text string")
    got = {(r["doc"], r["block"], r["entity_name"]) for r in D.mentions(entities, blocks, spark.createDataFrame([("d", 4)], "doc string, block int"), "doc", "block").collect()}
    assert got == {("d", 1, "Rated Power"), ("d", 2, "Rated Power")}
    lines = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(["a b  c", "abcdef", "xy", "", "other line", "abcdef"])], "doc string, block_id int, line_id int, raw_text string")
    cited = spark.createDataFrame([("d", 1, "x a b c y"), ("d", 1, "bcd"), ("d", 1, "bcd"), ("d", 2, "other line")], "doc string, block_id int, evidence_text string")
    assert {r["line_id"] for r in V.line_coverage(lines, cited).where("covered").collect()} == {0, 1, 5}


def test_tail_reads_complete_lines_once(spark, tmp_path):
    folder, ck = tmp_path / "logs", tmp_path / "ck"
    folder.mkdir()
    spark.dataSource.register(LineTail)

    def batch():
        out = []
        stream = spark.readStream.format("line_tail").option("path", str(folder)).option("suffix", ".log").option("max_bytes", 64).option("slice_bytes", 7).load()
        query = stream.writeStream.option("checkpointLocation", str(ck)).foreachBatch(lambda df, _: out.extend((os.path.basename(r["path"]), r["offset"], r["value"]) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(out)

    one = folder / "a.log"
    one.write_bytes(b"first\r\nsecond\n\nha")
    (folder / "b.txt").write_text("not this\n")
    assert batch() == [("a.log", 0, "first"), ("a.log", 7, "second"), ("a.log", 14, "")]
    with one.open("ab") as file:
        file.write("lf ü\nnext".encode())
    (folder / "b.log").write_bytes(b"x" * 150 + b"\n")
    assert batch() == [("a.log", 15, "half ü"), ("b.log", 0, "x" * 150)]
    assert batch() == []
    one.write_bytes(b"anew\n")  # written anew, shorter
    assert batch() == [("a.log", 0, "anew")]
    (folder / "c.log").write_bytes(b"y" * 130)  # a long line that is not over: its whole parts
    assert complete_end(str(folder / "c.log"), 64) == 128 and [x[1:] for x in batch()] == [(0, "y" * 64), (64, "y" * 64)]


def test_slices_share_out_the_lines(tmp_path):
    rng = random.Random(5)
    text = "".join("z" * rng.choice([0, 1, 5, 40]) + "\n" for _ in range(200))
    (tmp_path / "f.log").write_text(text)
    for size in (1, 3, 17, 10_000):
        reader = TailReader({"path": str(tmp_path), "slice_bytes": str(size)})
        end = reader.latestOffset()
        assert "".join(v + "\n" for s in reader.partitions({}, end) for _, _, v in reader.read(s)) == text


def test_silence_in_a_stream_as_in_the_batch(spark, tmp_path):
    rng = random.Random(8)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted({("abc"[rng.randrange(3)], rng.randrange(0, 400)) for _ in range(40)} | {("quiet", 5), ("done", 9), ("late", 399)}, key=lambda r: r[1])
    rows = [(job, at, job == "done" or (job == "a" and at > 300)) for job, at in rows]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(0, len(rows), 12):
        (source / f"{k:03}.json").write_text("".join(json.dumps({"job": j, "s": s, "final": f}) + "\n" for j, s, f in rows[k : k + 12]))
        os.utime(source / f"{k:03}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "job string, s long, final boolean"
    timed = lambda df: df.select("job", F.timestamp_seconds("s").alias("ts"), "final")
    out = []
    stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))).withWatermark("ts", "0 seconds")
    query = watch_stream(stream, 30.0, 60.0).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(180)
    want = [tuple(r) for r in watch_batch(timed(spark.read.schema(schema).json(str(source))), 30.0, 60.0, 399.0).collect()]
    assert sorted(out) == sorted(want) and {"stalled", "moving", "final", "expired"} <= {r[1] for r in want}
