import datetime
import random

import numpy as np

from pyspark.sql import functions as F

from concord.operators import batches as B
from concord.operators import diagnose as D
from concord.operators import events as E
from concord.operators import facts as V
from concord.operators import graph as G
from concord.operators import retrieval as R


def test_mmr_caps_documents_and_diversifies(spark):
    rows = [(1, 1, "a", 1.0, 1, [1.0, 0.0]), (1, 2, "b", 0.99, 2, [1.0, 0.0]), (1, 3, "c", 0.5, 3, [0.0, 1.0]), (1, 4, "a", 0.4, 4, [0.7, 0.7])]
    pool = spark.createDataFrame(rows, "query_id int, item_id int, doc_id string, score double, rank int, vector array<double>")
    picked = [r["item_id"] for r in R.mmr(pool, 4, 0.2, 1).orderBy("rank").collect()]
    assert picked[:2] == [1, 3] and 4 not in picked


def test_nearest_keeps_any_type_of_id_and_meets_in_blocks(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 4))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for kind, make in (("int", int), ("short", int), ("string", str), ("date", lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=int(k)))):
        q = spark.createDataFrame([(make(k), v[k].tolist()) for k in range(7)], f"id {kind}, v array<double>")
        c = spark.createDataFrame([(make(k), v[k].tolist()) for k in range(60)] + [(make(90), None), (make(91), [1.0, None, 0.0, 0.0]), (make(92), [1.0])], f"id {kind}, v array<double>")
        got = sorted(R.cosine_top(q, c, "id", "id", "v", 3, query_block=3, corpus_block=20).collect(), key=lambda x: x["rank"])
        for k in range(7):
            score = np.round(unit[k] @ unit.T, 6)
            assert [x["doc_id"] for x in got if x["query_id"] == make(k)] == [make(j) for j in sorted(range(60), key=lambda j: (-score[j], make(j)))[:3]]


def test_hybrid_on_an_empty_index(spark):
    q = spark.createDataFrame([(1, "a", [1.0])], "query_id int, text string, vector array<double>")
    items = spark.createDataFrame([], "item_id int, doc_id string, text string, vector array<double>")
    assert R.hybrid(q, items).count() == 0


def test_constrained_merge_matches_a_sequential_fold(spark):
    rng = random.Random(4)
    for _ in range(3):
        edges = [(k, rng.randrange(12), rng.randrange(12), rng.choice(["same_as", "same_as", "differs_by"]), rng.random() < 0.3) for k in range(16)]
        edges = [e for e in edges if e[1] != e[2]]
        parent = {i: i for i in range(12)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        apart = [(a, b) for _, a, b, r, _ in edges if r == "differs_by"]
        fate = {}
        for k, a, b, _, _ in sorted((e for e in edges if e[3] == "same_as"), key=lambda e: (not e[4], e[0])):
            x, y = find(a), find(b)
            if x == y or not any({find(p), find(q)} == {x, y} for p, q in apart):
                fate[k] = "merged"
                parent[x] = y
            else:
                fate[k] = "differs_by"
        got = G.constrained_merge(spark.createDataFrame(edges, "pos long, left_id long, right_id long, relation string, promoted boolean")).where("kind = 'edge'").collect()
        assert {r["id"]: r["value"] for r in got} == fate


def test_components_of_chains_and_nulls(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (None, 5)]
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(31)} == {0} and got[101] == 100


def test_verdicts_defer_on_any_undecided_attribute(spark):
    a = "map<string,struct<value:string,unit:string>>"
    df = spark.sql(f"select cast(map('x', struct('1', ''), 'y', struct('q', '')) as {a}) a, cast(map('x', struct('2', ''), 'y', struct('r', '')) as {a}) b, cast(map('lower_limit', struct('1', '')) as {a}) c, cast(map('upper_limit', struct('1', '')) as {a}) d")
    r = df.select(V.code_verdict(V.attribute_states(F.col("a"), F.col("b"))).alias("x"), V.code_verdict(V.attribute_states(F.col("c"), F.col("d"))).alias("y"), V.attribute_coverage(F.col("a"), F.col("c")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (None, None, 0.0)


def test_greedy_packing_keeps_groups_whole(spark):
    g = spark.createDataFrame([("d", k, n) for k, n in enumerate([3, 3, 9, 1, 1])], "doc string, k int, n int")
    assert [r["batch"] for r in B.pack_groups(g, "doc", "k", "n", 6).orderBy("k").collect()] == [0, 0, 1, 2, 2]


def test_limiter_and_missing_cause(spark):
    e = spark.sql("select 'u' user_id, id event_id, timestamp_seconds(0) ts from range(5)")
    assert [r["waited"] for r in E.admissions(e, "user_id", 2, 60.0).orderBy("event_id").collect()] == [0.0, 0.0, 60.0, 60.0, 120.0]
    case = spark.sql("select false decided_by_model, true edge_rejected, true edge_unknown, 1 n_blockers, 0 n_cited_blocks, 0 n_candidates, 0 n_kept, 0d best_score, 1d floor")
    assert D.missing_cause(case).first()["cause"] == "evidence_gate"


def test_routing_without_a_model(spark):
    from concord.operators import matching as M
    from concord.plans.compare import compare_facts

    schema = "doc string, fact_id string, entity_name string, attributes map<string,struct<value:string,unit:string>>, evidence_text string, pos long"
    same = {"target_value": ("3", "v")}
    ref = spark.createDataFrame([("r", "a", "Ａlpha", same, "e", 0), ("r", "b", "Beta", same, "e", 1), ("r", "c", "Gamma", same, "e", 2), ("r", "d", "Delta", same, "e", 3)], schema)
    tgt = spark.createDataFrame([("t", "1", "alpha", same, "e", 0), ("t", "2", "alpha", {}, "e", 1), ("t", "3", "beta", same, "e", 2), ("t", "4", "else", same, "e", 3), ("t", "5", "more", same, "e", 4)], schema)
    ranked = spark.createDataFrame([("c", "t", "4", 0.9, 1, False), ("c", "t", "5", 0.8, 2, False), ("a", "t", "5", 0.9, 1, True)], "ref_id string, target_doc string, target_id string, score double, rank int, needs_review boolean")
    low = spark.createDataFrame([("t", "3")], "doc string, fact_id string")
    got = {r["fact_id"]: r for r in compare_facts(ref, tgt, low, ranked).collect()}
    assert {k: (r["result"], r["decided_by"], r["n_candidates"]) for k, r in got.items()} == {"a": ("match", "code", 1), "b": ("unknown", "", 1), "c": ("unknown", "", 2), "d": ("missing", "code", 0)}
    assert got["b"]["triggers"] == ["low_confidence"] and got["c"]["triggers"] == ["duplicate_entity_facts"] and got["d"]["triggers"] == ["code_missing"]
    golden = spark.createDataFrame([(1, "t", "alpha", "match"), (2, "t", "bet", "match"), (3, "t", "zzz", "match")], "golden_id long, doc string, entity_name string, expected string")
    answers = spark.createDataFrame([("t", "Beta max", "mismatch", 2), ("t", "Alpha", "match", 1), ("u", "zzz", "match", 3)], "doc string, entity_name string, result string, pos long")
    scored = M.score_engine(golden, answers)
    assert {r["golden_id"]: r["result"] for r in scored.collect()} == {1: "match", 2: "mismatch", 3: None}
    assert M.engine_stats(scored).first().asDict() == {"hits": 1, "misses": 1, "unmatched": 1, "accuracy": 0.5}


def test_bm25_in_blocks_equals_brute_force(spark):
    import math

    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30)))) for k in range(90)]
    queries = [(k, " ".join(rng.choice("abcdefghz") for _ in range(4))) for k in range(12)]
    got = R.bm25_top(spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(docs, "d int, text string"), "q", "d", 4, query_block=5, corpus_block=20).collect()
    bags = {d: t.split() for d, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    want = set()
    for q, text in queries:
        scores = {}
        for d, bag in bags.items():
            s = 0.0
            for term in set(text.split()):
                tf, df = bag.count(term), sum(term in b for b in bags.values())
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean)) if tf else 0.0
            if s > 0:
                scores[d] = round(s, 6)
        want |= {(q, d, n + 1) for n, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:4])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == want


def test_numbers_within_keys_of_any_size(spark):
    from concord.operators.ordering import number_rows

    rows = [(None if k % 7 == 0 else k % 3, (k * 37) % 101) for k in range(101)]
    got = number_rows(spark.createDataFrame(rows, "k int, v int"), ["v"], "n", ["k"]).collect()
    for key in {k for k, _ in rows}:
        assert [r["v"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["n"])] == sorted(v for k, v in rows if k == key)
