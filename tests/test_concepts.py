"""Concept graphs: merging by rounds against a sequential fold, also of one giant component; the whole way from pairs to verdicts."""

import random

from pyspark.sql import functions as F

from concord.operators import concepts as C
from concord.operators import graph as G
from concord.plans.compare import build_concepts, compare_by_concept

EDGES = "pos long, left_id long, right_id long, relation string, promoted boolean"


def fold(edges):
    """One edge after another."""
    ids = {x for e in edges for x in e[1:3]}
    held, members = {i: i for i in ids}, {i: {i} for i in ids}
    apart = {}
    for _, a, b, r, _ in edges:
        if r == "differs_by" and a != b:
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
    fate = {}
    for pos, a, b, r, _ in sorted((e for e in edges if e[3] == "same_as"), key=lambda e: (not e[4], e[0])):
        x, y = held[a], held[b]
        if x != y and any(apart.get(m, set()) & members[y] for m in members[x]):
            fate[pos] = "differs_by"
            continue
        fate[pos] = "merged"
        if x != y:
            for m in members[x]:
                held[m] = y
            members[y] |= members.pop(x)
    return fate, {i: str(min(members[held[i]])) for i in ids}


def test_a_giant_component_merges_as_one_by_one(spark):
    rng = random.Random(7)
    same = [(k, rng.randrange(500), rng.randrange(500), "same_as", rng.random() < 0.1) for k in range(1500)]
    same += [(2000 + k, k, k + 1, "same_as", False) for k in range(499)]
    apart = [(5000 + k, rng.randrange(500), rng.randrange(500), "differs_by", False) for k in range(40)] + [(6000, 3, 3, "differs_by", False), (6001, None, 4, "differs_by", False), (6002, None, 4, "same_as", False)]
    edges = same + apart
    got = G.constrained_merge(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(900,)], "id long")).collect()
    fate, least = fold([e for e in edges if e[1] is not None])
    assert len(set(fate.values())) == 2
    assert {r["id"]: r["value"] for r in got if r["kind"] == "edge"} == fate
    assert {r["id"]: r["value"] for r in got if r["kind"] == "node"} == least | {900: "900"}
    assert G.constrained_merge(spark.createDataFrame([], EDGES)).count() == 0


A = "map<string,struct<value:string,unit:string>>"
FACT = f"doc string, fact_id long, entity_name string, pos long, evidence_text string, search_text string, attributes {A}"


def facts(spark, doc, *rows):
    return spark.createDataFrame([(doc, k, n, k, e, "", {"size": (v, "")}) for k, n, e, v in rows], FACT)


def test_from_pairs_to_verdicts(spark):
    ref = facts(spark, "sheet", (1, "Nominal capacity", "1150 mAh at 20 C", "1150"), (2, "Weight", "weight 12 g net", "12"), (3, "Width", "5 mm wide and more", "5"), (4, "Depth", "", "7"))
    targets = facts(spark, "a", (11, "nominal-capacity", "1150 mAh", "1150"), (12, "Mass", "mass of 12 g net", "13"), (13, "Breadth", "breadth 5 mm wide", "5")).unionByName(facts(spark, "b", (21, "Mass", "mass is 12 g", "12")))
    entries = spark.createDataFrame([(1, "Weight", "Mass", "same_as", "")], "pos long, left string, right string, relation string, axis string")
    ontology = G.expand_ontology(entries, spark.createDataFrame([], "group_id long, name string"))
    ranked = spark.createDataFrame([(3, "a", 13, 0.7, 1, False), (4, "a", 13, 0.6, 1, False), (4, "b", 21, 0.5, 1, True)], "ref_id long, target_doc string, target_id long, score double, rank int, needs_review boolean")
    answers = [(3, "a", 13, "same_as", "", "5 mm wide and more", "breadth 5 mm wide", 1), (4, "a", 13, "same_as", "", "deep deep deep", "breadth 5 mm wide", 2), (9, "a", 13, "same_as", "", "", "", 3), (4, "b", 21, "nonsense", "", "", "", 4)]
    said = spark.createDataFrame(answers, "ref_id long, target_doc string, target_id long, relation string, axis string, left_text string, right_text string, pos long")
    graph = build_concepts(ref, targets, ontology, ranked, said)
    got = {(r["ref_id"], r["target_id"]): (r["relation"], r["decided_by"], r["rejected_by"], r["promoted"]) for r in graph.edges.collect()}
    assert got == {(1, 11): ("same_as", "code", "", False), (2, 12): ("same_as", "ontology", "", True), (2, 21): ("same_as", "ontology", "", True), (3, 13): ("same_as", "model", "", False), (4, 13): ("unknown", "model", "evidence", False), (4, 21): ("unknown", "model", "", False)}
    assert [(r["concept_id"], r["label"], r["n_docs"]) for r in graph.nodes.orderBy("concept_id").collect()] == [("c-0001", "Nominal capacity", 2), ("c-0002", "Weight", 3), ("c-0003", "Width", 2), ("c-0004", "Depth", 1)]
    stats = graph.stats.first().asDict()
    assert (stats["same_as"], stats["unknown"], stats["rejected_evidence"], stats["pairs_considered"], stats["pairs_added_by_ontology"]) == (4, 2, 1, 6, 2)
    verdict = {(r["fact_id"], r["target_doc"]): (r["result"], r["code_result"], r["needs_review"]) for r in compare_by_concept(ref, targets, graph).collect()}
    assert verdict == {(1, "a"): ("match", "match", False), (1, "b"): ("missing", "missing", False), (2, "a"): ("mismatch", "mismatch", False), (2, "b"): ("match", "match", False), (3, "a"): ("unknown", "match", True), (3, "b"): ("missing", "missing", False), (4, "a"): ("missing", "missing", False), (4, "b"): ("missing", "missing", False)}
    alone = build_concepts(ref, targets.limit(0), ontology)
    assert alone.edges.count() == 0 and alone.nodes.count() == 4 and compare_by_concept(ref, targets.limit(0), alone).count() == 0


def test_pairs_keep_what_found_them(spark):
    ref = facts(spark, "sheet", (1, "Weight", "", "1"))
    targets = facts(spark, "a", (11, "Weight", "", "1"), (12, "Mass", "", "1"))
    entries = spark.createDataFrame([(1, "Weight", "Mass", "differs_by", "net")], "pos long, left string, right string, relation string, axis string")
    ontology = G.expand_ontology(entries, spark.createDataFrame([(1, "Mass"), (1, "Bulk")], "group_id long, name string"))
    got = {r["target_id"]: (r["exact"], r["recalled"], r["relation"], r["axis"], r["score"]) for r in C.concept_pairs(ref, targets, None, ontology).collect()}
    assert got == {11: (True, True, None, None, 1.0), 12: (False, False, "differs_by", "net", 0.0)}
    assert C.decide(C.concept_pairs(ref, targets, None, ontology)).where(F.col("decided_by") == "").count() == 0
