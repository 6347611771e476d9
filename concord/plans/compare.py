"""The two comparisons end to end, with text generation and embedding as optional providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import concepts as C
from ..operators import facts as V
from ..operators import matching as J
from ..operators import retrieval as R

#: Adds a column ``vector`` to items with a column ``text``.
Embedder = Callable[[DataFrame], DataFrame]


def search_candidates(reference: DataFrame, targets: list[DataFrame], embed: Embedder = R.with_hash_vectors, chunk: int = 800, **knobs) -> DataFrame:
    """Candidates of each reference item (query_id, text) among the chunks of all targets (item_id, doc_id, text)."""
    items = targets[0]
    for other in targets[1:]:
        items = items.unionByName(other)
    cut = R.chunk_items(items, chunk)
    return R.hybrid(embed(reference), embed(cut), **knobs)


def compare_facts(reference: DataFrame, targets: DataFrame, low: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """Verdicts of reference facts against each target document's facts, with the gate's reasons and no model.

    A fact is matched by its name; where that misses, by the first of ``ranked`` candidates (ref_id, target_doc, target_id, rank,
    needs_review) of the document.  ``low`` (doc, fact_id) are facts of low confidence.
    """
    candidates = J.candidates(reference, targets, ranked)
    return V.route(V.compare(J.attach(reference, targets, candidates)), low)


def build_concepts(reference: DataFrame, targets: DataFrame, ontology: DataFrame, ranked: DataFrame | None = None, answers: DataFrame | None = None, keep: int = 5) -> C.ConceptGraph:
    """The concept graph of all facts: candidates and what the ontology knows, decided, proven, merged and numbered."""
    pairs = C.concept_pairs(reference, targets, ranked, ontology, keep)
    return C.assemble(reference, targets, C.prove(C.decide(pairs, answers), reference, targets))


def compare_by_concept(reference: DataFrame, targets: DataFrame, graph: C.ConceptGraph, low: DataFrame | None = None) -> DataFrame:
    """Verdicts of reference facts against the facts of their concept in each target document, with the gate's reasons and no model."""
    candidates = C.concept_order(reference, targets, graph)
    return V.route(V.compare(J.attach(reference, targets, candidates)), low)
