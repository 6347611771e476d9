"""What grows with the input alone: sums after dealing, pairs of texts by blocks."""

import random

from concord.operators import diagnose as D
from concord.operators import graph as G
from concord.operators import places as P
from concord.operators import retrieval as R
from concord.operators import scoring as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forms_are_dealt_before_they_are_summed(spark):
    """Pairs of forms are not sorted in the task that read the entries."""
    entries = spark.createDataFrame([(1, "a", "b", "same_as", "x"), (2, "b", "a", "differs_by", "y"), (3, "a", "b", "same_as", "z")], "pos long, left string, right string, relation string, axis string")
    aliases = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "group_id long, name string")
    got = G.expand_ontology(entries, aliases)
    shown = plan(got)
    assert 0 < shown.index("partial_max") < shown.index("Exchange")
    assert sorted(map(tuple, got.collect())) == [("a", "b", "differs_by", "y"), ("b", "c", "differs_by", "y")]


def test_overlaps_by_blocks(spark):
    """Pairs of texts meet by blocks, not by a join on tokens; all pairs are found, ties at the rounding too."""
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n))
    golden = [(k, said(rng.randrange(0, 9))) for k in range(40)] + [(40, ""), (41, None)]
    facts = [(k, said(rng.randrange(0, 12))) for k in range(300)] + [(300, None), (301, "")]
    g, f = spark.createDataFrame(golden, "golden_id long, golden_text string"), spark.createDataFrame(facts, "fact_id long, fact_text string")
    words = lambda t: set((t or "").split())
    best, cover = {}, set()
    for i, a in golden:
        for j, b in facts:
            x, y = words(a), words(b)
            jaccard = round(len(x & y) / len(x | y), 6) if x | y else 0.0
            if x and jaccard >= 0.3 and (jaccard, -j) > best.get(i, (0, 0)):
                best[i] = jaccard, -j
            if x and len(x & y) / len(x) >= 0.6:
                cover.add((i, j, round(len(x & y) / len(x), 6)))
    got, held = D.best_overlap(g, f), S.covering_facts(g, f, 0.6)
    assert {r["golden_id"]: (r["overlap"], -r["fact_id"]) for r in got.collect()} == best
    assert {(r["golden_id"], r["fact_id"], r["ratio"]) for r in held.collect()} == cover
    assert all("CoGroup" in plan(d) and "Join" not in plan(d) for d in (got, held))


def test_coverage_deals_cells_once(spark):
    """Coverage by bands equals coverage by pairs of cell and claim, and repeated cells count once; pairs do not travel."""
    rng = random.Random(6)
    cells = spark.createDataFrame([("d", rng.choice("st"), rng.randrange(1, 150), rng.randrange(1, 6)) for _ in range(500)] + [(None, None, 2, 2)], "doc string, sheet string, row int, col int")
    spans = [(rng.randrange(1, 140), rng.randrange(1, 6)) for _ in range(30)]
    claims = spark.createDataFrame([("d", rng.choice("st"), k, f"A{r}:{'ABCDE'[c - 1]}{r + k % 9}") for k, (r, c) in enumerate(spans)], "doc string, sheet string, fact_id long, cell_range string")
    got = P.sheet_coverage(claims, cells, 16)
    rows = lambda df: sorted(map(repr, df.select("doc", "sheet", "n_cells", "n_cited", "n_uncited_rows").collect()))
    assert rows(got) == rows(P.cell_coverage(cells.distinct(), P.cited_cells(claims, cells.distinct())))
    assert plan(got).split("== Initial Plan ==")[-1].count("Exchange") <= 3


def test_scores_of_one_key_by_blocks(spark):
    """Vectors of a key meet by blocks, however they are dealt; null keys and vectors meet nothing, a zero vector scores 0."""
    rng = random.Random(7)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)], rng.choice([1, 2, None])) for k in range(80)] + [(80, [0.0, 0.0, 0.0], 1), (81, None, 1), (82, [1.0, None, 2.0], 1), (83, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, key int")
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v]
    whole = [(k, unit(v), key) for k, v, key in rows if key and v and None not in v]
    want = {(a, b): round(sum(x * y for x, y in zip(v, w)), 6) for a, v, ka in whole if a % 4 == 0 for b, w, kb in whole if ka == kb and len(v) == len(w)}
    for blocks in ((2048, 8192, 1000), (3, 5, 1)):
        got = R.cosine_scores(df.where("id % 4 = 0"), df, "id", "id", "v", "key", -0.1, *blocks)
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()} == {k: s for k, s in want.items() if s >= -0.1}
    assert "CoGroup" in plan(got)


def test_vectors_of_items_are_made_once(spark, monkeypatch):
    """Both rankers and the pool read items that were written once."""
    seen = []
    keep = R.written
    monkeypatch.setattr(R, "written", lambda df, name: seen.append(name) or keep(df, name))
    items = R.with_hash_vectors(spark.createDataFrame([(k, k % 2, f"word{k} common") for k in range(6)] + [(9, 0, " ")], "item_id long, doc_id long, text string"))
    got = R.hybrid(R.with_hash_vectors(spark.createDataFrame([(1, "word3 common")], "query_id long, text string")), items)
    assert seen.count("items") == 1 and got.orderBy("rank").first()["item_id"] == 3 and "MapInArrow" not in plan(got).split("== Initial Plan ==")[0].split("FlatMapGroupsInPandas")[-1].split("CoGroup")[0]


def test_a_graph_makes_what_is_asked_of_it(spark, monkeypatch):
    """Building a graph numbers no edges and no members and evaluates the pairs once; links keep their order all the same."""
    from concord.operators import concepts as C
    from concord.plans.compare import build_concepts

    seen, names = [], []
    number, write = C.number_rows, C.written
    monkeypatch.setattr(C, "number_rows", lambda *a, **b: seen.append(a) or number(*a, **b))
    monkeypatch.setattr(C, "written", lambda df, name: names.append(name) or write(df, name))
    fact = "doc string, fact_id long, entity_name string, pos long, evidence_text string, search_text string"
    ref = spark.createDataFrame([("r", k, f"part {k}", 9 - k, "e", "") for k in (1, 2)], fact)
    targets = spark.createDataFrame([("a", 11, "part 1", 1, "e", ""), ("a", 12, "part-2", 2, "e", "")], fact)
    onto = spark.createDataFrame([("part1", "part2", "differs_by", "x"), ("part1", "part1", "same_as", "x")], "name_lo string, name_hi string, relation string, axis string")
    ranked = spark.createDataFrame([(1, "a", 99, 0.5, 1, False), (7, "a", 11, 0.5, 1, False)], "ref_id long, target_doc string, target_id long, score double, rank int, needs_review boolean")
    graph = build_concepts(ref, targets, onto, ranked)
    assert not seen and names == ["decided", "edges"]
    got = {(r["ref_id"], r["target_id"]): (r["relation"], r["decided_by"], r["rejected_by"]) for r in graph.edges.collect()}
    assert got == {(1, 11): ("same_as", "ontology", ""), (1, 12): ("differs_by", "ontology", ""), (2, 11): ("differs_by", "ontology", ""), (2, 12): ("same_as", "code", "")}
    assert [r["label"] for r in graph.nodes.orderBy("concept_id").collect()] == ["part 2", "part 1"] and len(seen) == 1
    assert {r["fact_id"]: r["concept_id"] for r in graph.members.collect()} == {1: "c-0002", 2: "c-0001", 11: "c-0002", 12: "c-0001"}


def test_what_one_batch_holds_is_done_at_once(spark, monkeypatch):
    """Components that lie in one batch take no rounds."""
    monkeypatch.setattr(G, "_by_rounds", lambda near: 1 / 0)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 7], "a long, b long").coalesce(1)
    assert {r["node"]: r["component"] for r in G.components(edges).collect()} == {k: k if k % 7 == 1 else k - (k - 1) % 7 for k in range(1, 301)}


def test_lexical_blocks_are_bounded_by_their_terms(spark):
    """Long texts make more blocks, and a task holds few scores at once; the ranks stay the same."""
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30)))) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ranks = lambda **kw: sorted(map(tuple, R.bm25_top(df.where("doc_id % 4 = 0"), df, "doc_id", "doc_id", 5, **kw).select("query_id", "doc_id", "score", "rank").collect()))
    whole = ranks()
    assert whole and whole == ranks(postings_block=150, scores_held=40) == ranks(postings_block=40, scores_held=1)
