"""Concept graphs end to end: parts against what was sold of them under each return flag, fed by the operators before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import facts as V
from ..operators import trace as R
from ..operators.ordering import shuffled, written
from ..plans.compare import build_concepts, compare_by_concept
from ._tables import Registry, table
from .graphs import ontology

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: Parts are the reference; each return flag is a document with one fact per part, of which every fourth has only its other name.
#: The ontology relates a part to the next one.  A judge links a part without its own name to the part two on (or back, so that
#: six parts stay among themselves), with true quotes for every second of them.
_FACTS = """
    refs AS (SELECT p_partkey AS k, p_size, (p_partkey + 5) // 6 AS g, (p_partkey + 5) % 6 AS j FROM part),
    targets AS (
      SELECT l_returnflag AS doc, l_partkey AS k, l_partkey * 10 + strpos('ANR', l_returnflag) AS id, max(l_quantity) AS size,
        strpos('ANR', l_returnflag) AS d
      FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL
    ),
    pairs AS (
      SELECT r.k AS ref_id, t.doc AS target_doc, t.id AS target_id, t.k AS tk, t.d, r.g, r.j,
        CASE WHEN abs(r.k - t.k) = 1 THEN CASE WHEN least(r.k, t.k) % 3 = 0 THEN 'differs_by' ELSE 'same_as' END
          WHEN r.k = t.k OR r.k % 8 = 0 THEN 'same_as' ELSE 'unknown' END AS relation,
        CASE WHEN abs(r.k - t.k) = 1 THEN 'ontology' WHEN r.k = t.k THEN 'code' ELSE 'model' END AS decided_by,
        CASE WHEN abs(r.k - t.k) = 2 AND r.k % 8 <> 0 THEN 'evidence' ELSE '' END AS rejected_by
      FROM refs r JOIN targets t ON t.k BETWEEN r.k - 2 AND r.k + 2
      WHERE abs(r.k - t.k) = 1 OR (r.k = t.k AND r.k % 4 <> 0)
        OR (r.k % 4 = 0 AND t.k = CASE WHEN (r.k + 5) // 6 = (r.k + 7) // 6 THEN r.k + 2 ELSE r.k - 2 END)
    ),
    -- six parts in four documents are 24 places; a fold over the ordered links gives each place the label of its concept
    inside AS (SELECT *, j * 4 + 1 AS a, ((tk + 5) % 6) * 4 + d + 1 AS b FROM pairs WHERE (tk + 5) // 6 = g),
    apart AS (SELECT g, list([a, b]) AS apart FROM inside WHERE relation = 'differs_by' GROUP BY g),
    links AS (
      SELECT g, list([a, b] ORDER BY decided_by = 'ontology' DESC, decided_by = 'model', target_doc, ref_id, target_id) AS links
      FROM inside WHERE relation = 'same_as' GROUP BY g
    ),
    folded AS (
      SELECT g, list_reduce(list_prepend(list_transform(range(1, 25), lambda x: x::BIGINT), list_transform(coalesce(links, []), lambda e: list_transform(e, lambda x: x::BIGINT))),
        lambda held, e: CASE
          WHEN len(list_filter(coalesce(apart, []), lambda p: (held[p[1]] = held[e[1]] AND held[p[2]] = held[e[2]]) OR (held[p[1]] = held[e[2]] AND held[p[2]] = held[e[1]]))) > 0 THEN held
          ELSE list_transform(held, lambda v: CASE WHEN v = held[e[1]] THEN held[e[2]] ELSE v END) END) AS held
      FROM (SELECT DISTINCT g FROM refs) LEFT JOIN apart USING (g) LEFT JOIN links USING (g)
    ),
    edges AS (
      SELECT p.*, CASE WHEN p.relation = 'same_as' AND f.held[p.j * 4 + 1] <> f.held[((p.tk + 5) % 6) * 4 + p.d + 1] THEN 'differs_by' ELSE rejected_by END AS refused
      FROM pairs p JOIN folded f USING (g)
    ),
    final AS (
      SELECT ref_id, target_doc, target_id, CASE WHEN refused = 'differs_by' THEN 'unknown' ELSE relation END AS relation, decided_by, refused AS rejected_by
      FROM edges
    ),
    members AS (
      SELECT 0 AS side, 'parts' AS doc, k AS fact_id, k AS pos, g, f.held[j * 4 + 1] AS label, 'Part ' || k AS name FROM refs JOIN folded f USING (g)
      UNION ALL
      SELECT 1, doc, id, id, (k + 5) // 6, f.held[((k + 5) % 6) * 4 + d + 1], CASE WHEN k % 4 = 0 THEN 'no-' || k ELSE 'PART-' || k END
      FROM targets JOIN folded f ON f.g = (k + 5) // 6
    ),
    numbered AS (SELECT *, row_number() OVER (ORDER BY side, doc, pos) AS member_no FROM members)"""


def _facts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    reference = parts.select(
        F.lit("parts").alias("doc"), F.col("p_partkey").alias("fact_id"), named("Part ", "p_partkey").alias("entity_name"), F.col("p_partkey").alias("pos"),
        named("the size of part ", "p_partkey").alias("evidence_text"), F.lit("").alias("search_text"), V.attributes(size=(F.col("p_size"), "")).alias("attributes"),
    )
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.max("l_quantity").alias("most"))
    per = per.join(shuffled(parts.select(F.col("p_partkey").alias("l_partkey"))), "l_partkey", "left_semi")
    key = F.col("l_partkey") * 10 + F.instr(F.lit("ANR"), F.col("l_returnflag"))
    targets = per.select(
        F.col("l_returnflag").alias("doc"), key.alias("fact_id"), F.when(F.col("l_partkey") % 4 == 0, named("no-", "l_partkey")).otherwise(named("PART-", "l_partkey")).alias("entity_name"), key.alias("pos"),
        named("most that was sold of part ", "l_partkey").alias("evidence_text"), F.lit("").alias("search_text"), V.attributes(size=(F.col("most"), "")).alias("attributes"), "l_partkey",
    )
    return reference, targets


def _graph(spark, sf_dir):
    reference, sold = _facts(spark, sf_dir)
    # read several times below
    sold = written(sold, "targets")
    k = F.col("fact_id")
    on = F.when(F.floor((k + 5) / 6) == F.floor((k + 7) / 6), k + 2).otherwise(k - 2)
    near = reference.where(k % 4 == 0).select(k.alias("ref_id"), "evidence_text", on.alias("l_partkey"))
    near = shuffled(near).join(sold.select(F.col("doc").alias("target_doc"), k.alias("target_id"), F.col("evidence_text").alias("said"), "l_partkey"), "l_partkey")
    ranked = near.select("ref_id", "target_doc", "target_id", F.lit(0.5).alias("score"), F.lit(1).alias("rank"), F.lit(False).alias("needs_review"))
    quote = lambda c: F.when(F.col("ref_id") % 8 == 0, F.col(c)).otherwise("words that stand nowhere")
    answers = near.select("ref_id", "target_doc", "target_id", F.lit("same_as").alias("relation"), F.lit("").alias("axis"), quote("evidence_text").alias("left_text"), quote("said").alias("right_text"), F.col("ref_id").alias("pos"))
    targets = sold.drop("l_partkey")
    return reference, targets, build_concepts(reference, targets, ontology(spark, sf_dir), ranked, answers), ranked


@add(f"WITH {_FACTS} SELECT * FROM final")
def concept_edges(spark, sf_dir):
    """All pairs of the graph with their final relation, who decided it and what refused it."""
    return _graph(spark, sf_dir)[2].edges.select(*C.PAIR, "relation", "decided_by", "rejected_by")


@add(f"""WITH {_FACTS}, first AS (SELECT g, label, min(member_no) AS first, arg_min(name, member_no) AS name, count(DISTINCT doc) AS n_docs FROM numbered GROUP BY ALL)
    SELECT printf('c-%04d', row_number() OVER (ORDER BY first)) AS concept_id, name AS label, n_docs FROM first""")
def concept_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[2].nodes


@add(f"""WITH {_FACTS} SELECT count(*) FILTER (WHERE relation = 'same_as') AS same_as, count(*) FILTER (WHERE relation = 'differs_by') AS differs_by,
      count(*) FILTER (WHERE relation = 'unknown') AS unknown, count(*) FILTER (WHERE rejected_by = 'evidence') AS rejected_evidence,
      count(*) FILTER (WHERE rejected_by = 'differs_by') AS rejected_differs_by, count(*) AS pairs_considered,
      count(*) FILTER (WHERE decided_by = 'ontology') AS pairs_from_ontology, count(*) FILTER (WHERE decided_by = 'code') AS pairs_by_code,
      count(*) FILTER (WHERE decided_by = 'model') AS pairs_by_model, count(*) FILTER (WHERE decided_by = 'ontology') AS pairs_added_by_ontology
    FROM final""")
def concept_stats(spark, sf_dir):
    return _graph(spark, sf_dir)[2].stats


@add(f"""WITH {_FACTS}, partner AS (
      SELECT m.fact_id AS ref_id, t.doc AS target_doc, t.fact_id AS target_id,
        coalesce(f.relation = 'same_as' AND f.decided_by IN ('ontology', 'code'), false) AS sure
      FROM numbered m JOIN numbered t ON m.side = 0 AND t.side = 1 AND m.g = t.g AND m.label = t.label
      LEFT JOIN final f ON f.ref_id = m.fact_id AND f.target_id = t.fact_id
    ), best AS (SELECT ref_id, target_doc, count(*) AS n, min(target_id) AS target_id, arg_min(sure, target_id) AS sure FROM partner GROUP BY ALL),
    slots AS (SELECT k, p_size, doc FROM refs, (SELECT DISTINCT doc FROM targets)),
    compared AS (
      SELECT s.k, s.doc, b.n, b.target_id, b.sure, s.p_size, t.size,
        CASE WHEN b.n IS NULL THEN 'missing' WHEN s.p_size = t.size THEN 'match'
          WHEN greatest(s.p_size, t.size) / least(s.p_size, t.size)::DOUBLE IN (10, 100) THEN NULL ELSE 'mismatch' END AS code
      FROM slots s LEFT JOIN best b ON b.ref_id = s.k AND b.target_doc = s.doc LEFT JOIN targets t ON t.id = b.target_id
    )
    SELECT k AS fact_id, doc AS target_doc, target_id, coalesce(n, 0)::INT AS n_candidates, code AS code_result,
      CASE WHEN code = 'missing' OR (code IS NOT NULL AND sure AND n = 1) THEN code ELSE 'unknown' END AS result,
      CASE WHEN code = 'missing' OR (code IS NOT NULL AND sure AND n = 1) THEN 'code' ELSE '' END AS decided_by,
      CASE WHEN n IS NULL THEN 'code_missing' ELSE concat_ws(',', CASE WHEN code = 'mismatch' THEN 'code_mismatch' END, CASE WHEN code IS NULL THEN 'code_unknown' END,
        CASE WHEN NOT sure THEN 'low_confidence' END, CASE WHEN n > 1 THEN 'duplicate_entity_facts' END) END AS triggers
    FROM compared""")
def concept_verdicts(spark, sf_dir):
    """Verdicts of every part in every document through its concept, with the gate's reasons."""
    reference, targets, graph, _ = _graph(spark, sf_dir)
    rows = compare_by_concept(reference, targets, graph)
    return rows.select("fact_id", "target_doc", F.col("target.fact_id").alias("target_id"), "n_candidates", "code_result", "result", "decided_by", F.array_join("triggers", ",").alias("triggers"))


@add(f"""WITH {_FACTS}, slots AS (SELECT r.k, d.doc FROM refs r, (SELECT DISTINCT doc FROM targets) d),
    partner AS (
      SELECT DISTINCT m.fact_id AS k, t.doc FROM numbered m JOIN numbered t ON m.side = 0 AND t.side = 1 AND m.g = t.g AND m.label = t.label
    ), missing AS (SELECT s.* FROM slots s ANTI JOIN partner p ON p.k = s.k AND p.doc = s.doc),
    e AS (
      SELECT ref_id AS k, target_doc AS doc, count(*) AS n, count(*) FILTER (WHERE relation = 'differs_by') AS blockers,
        min(rejected_by) FILTER (WHERE relation = 'unknown' AND rejected_by <> '') AS refused, bool_or(relation = 'unknown' AND rejected_by = '') AS undecided
      FROM final GROUP BY ALL
    ), held AS (SELECT m.*, e.n, e.blockers, e.refused, coalesce(e.undecided, false) AS undecided FROM missing m LEFT JOIN e ON e.k = m.k AND e.doc = m.doc)
    SELECT k AS fact_id, doc AS target_doc,
      CASE WHEN refused IS NOT NULL THEN 'evidence_gate' WHEN undecided THEN 'llm_undecided' WHEN blockers > 0 THEN 'blocked' ELSE 'unresolved' END AS cause,
      CASE WHEN refused IS NOT NULL THEN refused WHEN undecided THEN 'absent'
        WHEN blockers > 0 THEN (SELECT p_brand FROM part WHERE p_partkey = CASE WHEN k % 3 = 0 THEN k ELSE k - 1 END) ELSE '' END AS subcause,
      CASE WHEN n IS NULL OR (refused IS NULL AND NOT undecided AND blockers = 0) THEN 'unresolved' ELSE 'confirmed' END AS confidence,
      CASE WHEN refused IS NOT NULL THEN 'recall+,judgement+,gate-,comparison-' WHEN undecided THEN 'recall+,judgement-,comparison-'
        WHEN blockers > 0 THEN 'concepts-,comparison-' ELSE 'recall-' END AS trail,
      coalesce((SELECT string_agg(f.target_id, ',' ORDER BY f.decided_by = 'model', f.target_id) FROM final f
        WHERE f.relation <> 'same_as' AND f.ref_id = k AND f.target_doc = doc), '') AS shown
    FROM held""")
def missing_traces(spark, sf_dir):
    """Why each part has no counterpart in a document, from the graph's own edges and rankings."""
    reference, targets, graph, ranked = _graph(spark, sf_dir)
    verdicts = written(compare_by_concept(reference, targets, graph).select("fact_id", "target_doc", "entity_name", "result", "decided_by"), "verdicts")
    cited = targets.groupBy("doc").agg(F.count(F.lit(1)).alias("n_cited"))
    ranking = ranked.withColumn("cut_by", F.lit(""))
    found = R.trace_missing(verdicts, graph.edges, ranking, cited)
    trail = F.array_join(F.transform("trail", lambda s: F.concat(s["stage"], F.when(s["ok"], "+").otherwise("-"))), ",")
    shown = F.array_join(F.transform("edges", lambda e: e["target_id"].cast("string")), ",")
    return found.select("fact_id", "target_doc", "cause", "subcause", "confidence", trail.alias("trail"), shown.alias("shown"))
