"""Concept graph: ontology, candidate pairs, known relations, components, constrained merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name
from .ordering import number_rows, shuffled, written


def expand_ontology(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_lo, name_hi, relation, axis): all pairs of alias forms of an entry's two names; the later entry wins, and
    ``differs_by`` over ``same_as``.  ``entries`` is (pos, left, right, relation, axis), ``aliases`` (group_id, name).

    Entries and pairs of forms are dealt anew by their names: a table of entries is small on disk, so one task reads many of them,
    and each grows to all pairs of its forms.
    """
    # read several times below
    names = written(aliases.select("group_id", norm_name("name").alias("name")).where("name <> ''").distinct(), "names")
    groups = names.groupBy("name").agg(F.min("group_id").alias("group_id"))
    sides = entries.select("pos", "relation", "axis", norm_name("left").alias("l"), norm_name("right").alias("r")).where("l <> '' and r <> ''").repartition("l")

    def spread(df: DataFrame, side: str) -> DataFrame:
        own = df.join(shuffled(groups.withColumnRenamed("name", side).withColumnRenamed("group_id", f"{side}_group")), side, "left")
        forms = names.select(F.col("group_id").alias(f"{side}_group"), F.col("name").alias(f"{side}_form"))
        return own.join(shuffled(forms), f"{side}_group", "left").withColumn(f"{side}_form", F.coalesce(f"{side}_form", side))

    both = spread(spread(sides, "l"), "r").where("l_form <> r_form and not (l_group <=> r_group and l_group is not null)")
    said = F.struct(F.when(F.col("relation") == "differs_by", 1).otherwise(0).alias("differs"), "pos", "relation", "axis")
    pairs = both.select(F.least("l_form", "r_form").alias("name_lo"), F.greatest("l_form", "r_form").alias("name_hi"), said.alias("said"))
    # hardly any pair repeats, so nothing is summed (and sorted) before it is dealt
    last = pairs.repartition("name_lo", "name_hi").groupBy("name_lo", "name_hi").agg(F.max("said").alias("said"))
    return last.select("name_lo", "name_hi", "said.relation", "said.axis")


def ontology_pairs(reference: DataFrame, targets: DataFrame, ontology: DataFrame) -> DataFrame:
    """Pairs of reference and target facts whose names the ontology relates, by an equality join on the ordered names."""
    r = reference.select(F.col("fact_id").alias("ref_id"), norm_name("entity_name").alias("r"))
    t = targets.select("doc", F.col("fact_id").alias("target_id"), norm_name("entity_name").alias("t"))
    both = ontology.select("relation", "axis", F.explode(F.array(F.struct(F.col("name_lo").alias("r"), F.col("name_hi").alias("t")), F.struct(F.col("name_hi").alias("r"), F.col("name_lo").alias("t")))).alias("p")).select("relation", "axis", "p.r", "p.t")
    return shuffled(r).join(both, "r").join(shuffled(t), "t").select("ref_id", "doc", "target_id", "relation", "axis")


def resolve_known(pairs: DataFrame, ontology: DataFrame) -> DataFrame:
    """Each pair (left_name, right_name, ...) with its relation and who decided it: ontology, equal names (code), or none."""
    keyed = pairs.withColumn("_l", norm_name("left_name")).withColumn("_r", norm_name("right_name")).withColumn("name_lo", F.least("_l", "_r")).withColumn("name_hi", F.greatest("_l", "_r"))
    joined = keyed.join(ontology.select("name_lo", "name_hi", F.col("relation").alias("_known")), ["name_lo", "name_hi"], "left")
    same = (F.col("_l") == F.col("_r")) & (F.col("_l") != "")
    return joined.withColumn("relation", F.coalesce("_known", F.when(same, "same_as"), F.lit("unknown"))).withColumn("decided_by", F.when(F.col("_known").isNotNull(), "ontology").when(same, "code").otherwise("")).drop("_l", "_r", "_known", "name_lo", "name_hi")


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each batch as edges (a node, the least node that the batch's edges join it with), the least itself included."""
    for batch in batches:
        ends = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[ends.indices.to_numpy()]
        a, b = at[: len(batch)], at[len(batch) :]
        root = np.arange(len(order))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        sorted_ids = ends.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([sorted_ids, sorted_ids.take(pa.array(root))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the least node reachable.

    Edges that stand near each other are first contracted where they stand, a batch at a time; only what several batches hold goes
    on.  Then each round points every node to its least neighbour, follows the pointers and contracts the edges, so rounds shrink
    by half at least; nodes learn their component by going back through the rounds.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    near = written(ends.mapInArrow(_star_batches, ends.schema), "edges")
    # a node of one batch is done; of one that several batches hold, the least of each are linked
    least = written(near.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("far")), "least")
    several = least.where("b <> far").select("a", F.col("b").alias("to"))
    links = near.join(shuffled(several), "a").where("b <> to").select(F.col("to").alias("a"), "b").distinct()
    near = written(links, "edges")
    if near.isEmpty():
        return least.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = _by_rounds(near)
    joined = least.select("a", "b").join(shuffled(found.select(F.col("node").alias("b"), "component")), "b", "left")
    return written(joined.select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component")), "labels")


def _by_rounds(near: DataFrame) -> DataFrame:
    """``components`` of edges that were contracted where they stand."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    rounds = []
    while True:
        least = both(near).groupBy(F.col("a").alias("comp")).agg(F.min("b").alias("parent")).select("comp", F.least("comp", "parent").alias("parent"))
        lead = _leads(least)
        rounds.append(lead)
        left = near.where("a <> b").join(lead.select(F.col("comp").alias("b"), F.col("root").alias("to")), "b").select("a", F.col("to").alias("b"))
        left = left.join(lead.select(F.col("comp").alias("a"), F.col("root").alias("to")), "a").select(F.col("to").alias("a"), "b").where("a <> b").distinct()
        near = written(left, "edges")
        if near.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        onward = found.select(F.col("comp").alias("root"), F.col("root").alias("far"))
        found = written(rounds.pop().join(onward, "root", "left").select("comp", F.coalesce("far", "root").alias("root")), "labels")
    return found.select(F.col("comp").alias("node"), F.col("root").alias("component"))


def partners(members: DataFrame) -> DataFrame:
    """Pairs of members of one concept in different documents: (concept_id, doc, fact_id, other_doc, other_id)."""
    other = members.select("concept_id", F.col("doc").alias("other_doc"), F.col("fact_id").alias("other_id"))
    return members.select("concept_id", "doc", "fact_id").join(other, "concept_id").where("doc <> other_doc")


def contradictions(edges: DataFrame) -> DataFrame:
    """Pairs that both same_as and differs_by edges join."""
    pairs = edges.groupBy(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi"))
    return pairs.agg(F.count_if(F.col("relation") == "same_as").alias("same"), F.count_if(F.col("relation") == "differs_by").alias("differs")).where("same > 0 and differs > 0")


def dangling(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end that is no member."""
    ids = members.select(F.col("fact_id").alias("_id")).distinct()
    left = edges.join(ids, edges["left_id"] == ids["_id"], "left_anti")
    right = edges.join(ids, edges["right_id"] == ids["_id"], "left_anti")
    return left.union(right).distinct()


def _leads(pointers: DataFrame) -> DataFrame:
    """(comp, root) of a forest (comp, parent) whose roots point to themselves: pointers double, three times a write, until none
    moves."""
    state = written(pointers, "pointers")
    while True:
        far = state
        for _ in range(3):
            onward = far.select(F.col("comp").alias("parent"), F.col("parent").alias("next"))
            far = far.select("comp", "parent").join(onward, "parent").select("comp", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved"))
        state = written(far, "pointers")
        if state.where("moved").isEmpty():
            return state.select("comp", F.col("parent").alias("root"))
        state = state.select("comp", "parent")


def _contraction(open_edges: DataFrame, apart: DataFrame) -> DataFrame:
    """(comp, parent): where each concept goes in this round.

    An edge that comes first at both its ends is decided: whatever touches either concept comes later.  A concept that no
    differs_by edge touches can never be refused, so it goes along its first edge whatever the other end waits for.
    """
    order = F.struct("rank", "left_comp", "right_comp")
    ends = open_edges.select(order.alias("edge"), F.explode(F.array(F.struct(F.col("left_comp").alias("comp"), F.col("right_comp").alias("other")), F.struct(F.col("right_comp").alias("comp"), F.col("left_comp").alias("other")))).alias("e"))
    first = ends.groupBy("e.comp").agg(F.min(F.struct("edge", F.col("e.other").alias("other"))).alias("first"))
    bound = apart.select(F.explode(F.array("lo", "hi")).alias("comp")).distinct().withColumn("bound", F.lit(True))
    first = first.join(bound, "comp", "left").select("comp", F.col("first.edge").alias("edge"), F.col("first.other").alias("other"), F.coalesce("bound", F.lit(False)).alias("bound"))
    theirs = first.select(F.col("comp").alias("other"), F.col("edge").alias("their_edge"))
    both = first.join(theirs, "other").withColumn("mutual", F.col("edge") == F.col("their_edge"))
    # of two that choose each other the lesser stays
    goes = (F.col("mutual") & (F.col("comp") > F.col("other"))) | (~F.col("mutual") & ~F.col("bound"))
    return both.select("comp", F.when(goes, F.col("other")).otherwise(F.col("comp")).alias("parent"))


def _merge_by_rounds(same: DataFrame, apart: DataFrame) -> DataFrame:
    """``constrained_merge`` of components of any size by the cluster: (kind, id, least, pos, fate) of edges ``same`` (rank, left, right) and
    pairs ``apart`` (lo, hi).

    The order is kept exactly, but not one edge at a time: each round refuses every edge between concepts that are apart, and
    contracts every edge that nothing before it can change.  Rounds grow with the logarithm of a component, and with the longest
    chain of edges in rising order whose ends are all bound by differs_by edges.
    """
    ids = same.select(F.explode(F.array("left", "right")).alias("id")).union(apart.select(F.explode(F.array("lo", "hi")))).distinct()
    same = same.select("rank", F.col("left").alias("left_comp"), F.col("right").alias("right_comp"))
    pair = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    labels = written(ids.select("id", F.col("id").alias("comp")), "labels")
    moved = lambda df, c, lead: df.join(lead.select(F.col("comp").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    fates, left, rounds = [], same, 0
    while True:
        marked = left.select("*", *pair("left_comp", "right_comp")).join(apart.withColumn("refused", F.lit(True)), ["lo", "hi"], "left")
        fate = F.when(F.col("left_comp") == F.col("right_comp"), "merged").when(F.col("refused"), "differs_by")
        judged = written(marked.select("rank", "left_comp", "right_comp", fate.alias("fate")), "edges")
        fates.append(judged.where("fate is not null").select(F.col("rank.pos").alias("pos"), "fate"))
        open_edges = judged.where("fate is null").drop("fate")
        if open_edges.isEmpty():
            break
        lead = _leads(_contraction(open_edges, apart))
        left = moved(moved(open_edges, "left_comp", lead), "right_comp", lead)
        apart = moved(moved(apart, "lo", lead), "hi", lead).select(*pair("lo", "hi")).distinct()
        labels, rounds = moved(labels, "comp", lead), rounds + 1
        if rounds % 3 == 0:
            apart, labels = written(apart, "apart"), written(labels, "labels")
    labels = written(labels, "labels")
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    nodes = labels.join(least, "comp").select("id", "least")
    out = fates[0]
    for part in fates[1:]:
        out = out.unionByName(part)
    return nodes.unionByName(out, allowMissingColumns=True)


#: Edges of a component that is merged by one task, row by row; larger ones are merged by rounds.
FOLDED = 100_000


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, late, pos, left, right) in order, a component's pairs that are apart (late null) before its links, as
    (id, least, pos, fate)."""
    component, least, apart, nodes, kinds = None, {}, {}, [], None
    names = ["id", "least", "pos", "fate"]

    def find(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    def held() -> pa.RecordBatch:
        ends = [pa.array([n[k] for n in nodes], kinds[0]) for k in (0, 1)]
        done = pa.RecordBatch.from_arrays([*ends, *(pa.nulls(len(nodes), k) for k in kinds[1:])], names=names)
        nodes.clear()
        return done

    for batch in batches:
        kinds, fates = (batch.schema.field("left").type, batch.schema.field("pos").type, pa.string()), []
        for c, late, a, b in zip(*(batch.column(k).to_pylist() for k in ("component", "late", "left", "right"))):
            if c != component:
                nodes.extend((x, find(x)) for x in least)
                component, least, apart = c, {}, {}
            least.setdefault(a, a)
            least.setdefault(b, b)
            if late is None:
                apart.setdefault(a, set()).add(b)
                apart.setdefault(b, set()).add(a)
                continue
            x, y = find(a), find(b)
            if x != y and y in apart.get(x, ()):
                fates.append("differs_by")
                continue
            fates.append("merged")
            if x != y:
                x, y = min(x, y), max(x, y)
                least[y] = x
                for z in apart.pop(y, ()):
                    apart[z].discard(y)
                    apart[z].add(x)
                    apart.setdefault(x, set()).add(z)
        # the places of a batch's links are handed on as they are
        places = batch.column("pos").filter(batch.column("late").is_valid())
        none = pa.nulls(len(places), kinds[0])
        yield pa.RecordBatch.from_arrays([none, none, places, pa.array(fates, kinds[2])], names=names)
        if len(nodes) > 10_000:
            yield held()
    nodes.extend((x, find(x)) for x in least)
    if nodes:
        yield held()


def constrained_merge(edges: DataFrame, members: DataFrame | None = None, folded: int = FOLDED) -> DataFrame:
    """Merge same_as edges (pos, left_id, right_id, relation, promoted) one after another, promoted ones first, else by pos; an edge that
    would bring the two ends of a differs_by edge together is refused.

    Returns (kind, id, value): for each node (an end of any edge, or one of ``members`` with a column id) the least node of its
    concept, for each same_as edge (by pos) its fate, ``merged`` or ``differs_by``.

    Only what same_as edges join can be refused or merged, so each of their components stands alone: one without a differs_by edge
    inside is a concept as it is; of the others those of up to ``folded`` edges are merged edge by edge, many in a task, and larger
    ones by rounds of the cluster.
    """
    kept, nodes, fates, free = _merged(edges, folded)
    every = kept.where("relation <> 'same_as' or relation is null").select(F.explode(F.array("left_id", "right_id")).alias("id"))
    every = every if members is None else every.union(members.select("id").where("id is not null"))
    named = nodes.unionByName(every, allowMissingColumns=True)
    nodes = named.groupBy("id").agg(F.min("least").alias("least")).select(F.lit("node").alias("kind"), "id", F.coalesce("least", "id").cast("string").alias("value"))
    kind = edges.schema["left_id"].dataType
    fates = fates.unionByName(free.select("pos", F.lit("merged").alias("fate")))
    return nodes.unionByName(fates.select(F.lit("edge").alias("kind"), F.col("pos").cast(kind).alias("id"), F.col("fate").alias("value")))


def merged_and_refused(edges: DataFrame, folded: int = FOLDED) -> tuple[DataFrame, DataFrame]:
    """What ``constrained_merge`` changes: (id, least) of the ends of same_as edges, and (pos) of refused edges; ``pos`` may be of any
    type that has an order, a struct too."""
    _, nodes, fates, _ = _merged(edges, folded)
    return nodes, fates.where("fate = 'differs_by'").select("pos")


def _merged(edges: DataFrame, folded: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The edges as written, (id, least) of the ends of same_as edges, (pos, fate) of edges in components with a pair apart, and (pos)
    of all other same_as edges."""
    rank = F.struct((~F.coalesce(F.col("promoted"), F.lit(False))).alias("late"), F.col("pos").alias("pos"))
    # read several times below
    kept = written(edges.select("pos", "left_id", "right_id", "relation", "promoted").where("left_id is not null and right_id is not null"), "links")
    same = kept.where("relation = 'same_as'").select(rank.alias("rank"), F.col("left_id").alias("left"), F.col("right_id").alias("right"))
    apart = kept.where("relation = 'differs_by' and left_id <> right_id").select(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi"))
    label = components(same.select(F.col("left").alias("a"), F.col("right").alias("b")))
    of = lambda c, name: label.select(F.col("node").alias(c), F.col("component").alias(name))
    inside = written(shuffled(apart).join(of("lo", "component"), "lo").join(shuffled(of("hi", "other")), "hi").where("component = other").select("component", "lo", "hi").distinct(), "apart")
    held = inside.select("component").distinct()
    # only components with a pair apart go on
    bound = written(label.join(shuffled(held), "component", "left_semi").select(F.col("node").alias("left"), "component"), "bound")
    links = same.join(shuffled(bound), "left").select("component", "rank.late", "rank.pos", "left", "right")
    rows = written(links.unionByName(inside.select("component", F.col("lo").alias("left"), F.col("hi").alias("right")), allowMissingColumns=True), "links")
    large = written(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > folded).select("component"), "sizes")
    any_large = not large.isEmpty()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    small = rows.join(large, "component", "left_anti") if any_large else rows
    small = small.repartition("component").sortWithinPartitions("component", F.col("late").asc_nulls_first(), "pos", "left", "right")
    out = written(small.mapInArrow(_fold_batches, f"id {kinds['left']}, least {kinds['left']}, pos {kinds['pos']}, fate string"), "folded")
    if any_large:
        whole = rows.join(large, "component", "left_semi")
        links = whole.where("late is not null").select(F.struct("late", "pos").alias("rank"), "left", "right")
        out = out.unionByName(written(_merge_by_rounds(links, whole.where("late is null").select(F.col("left").alias("lo"), F.col("right").alias("hi"))), "large"))
    # a component with a pair apart is named by the nodes of its concepts
    alone = label.join(shuffled(held), "component", "left_anti").select(F.col("node").alias("id"), F.col("component").alias("least"))
    nodes = alone.unionByName(out.where("fate is null").select("id", "least"))
    free = same.join(shuffled(bound.select("left")), "left", "left_anti").select("rank.pos")
    return kept, nodes, out.where("fate is not null").select("pos", "fate"), free


def concept_nodes(members: DataFrame, concept: str = "root") -> DataFrame:
    """Concepts numbered by their first member: (concept, first, label, n_docs, concept_no, node_id such as ``c-0001``)."""
    nodes = members.groupBy(concept).agg(F.min("pos").alias("first"), F.min_by("entity_name", "pos").alias("label"), F.count_distinct("doc").alias("n_docs"))
    return number_rows(nodes, ["first"], "concept_no").withColumn("node_id", F.format_string("c-%04d", "concept_no"))


def demote_unproven(edges: DataFrame) -> DataFrame:
    """Proposed same_as edges (relation, verified, reason) without proof become unknown, with what rejected them before the reason."""
    lost = (F.col("relation") == "same_as") & ~F.col("verified")
    out = edges.withColumn("rejected_by", F.when(lost, "evidence").otherwise(""))
    return out.withColumn("reason", F.when(lost, F.concat(F.lit("[evidence] "), F.coalesce("reason", F.lit("")))).otherwise(F.col("reason"))).withColumn("relation", F.when(lost, "unknown").otherwise(F.col("relation")))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row of counts over final edges (relation, rejected_by)."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return edges.agg(count("relation", "same_as").alias("same_as"), count("relation", "differs_by").alias("differs_by"), count("relation", "unknown").alias("unknown"), count("rejected_by", "evidence").alias("rejected_evidence"))


def quote_stands(quote: str, evidence: str, search: str, name: str, coverage: float = 0.8, least: int = 3) -> Column:
    """Whether a quote is found in a fact's text and long enough (see ``verify_quotes``); the words of each are found once."""
    from ..functions.text import is_blank, once, tokens

    parts = {"quote": quote, "evidence": evidence, "name": name}
    words = F.struct(*(F.array_distinct(tokens(c)).alias(k) for k, c in parts.items()), tokens(F.concat_ws(" ", evidence, search, name)).alias("whole"))

    def holds(w: Column) -> Column:
        own, evidence, name = w["quote"], w["evidence"], w["name"]
        share = F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, w["whole"])) / F.size(own))
        equal = (F.size(F.array_except(own, evidence)) == 0) & (F.size(F.array_except(evidence, own)) == 0)
        named = (F.size(name) > 0) & (F.size(F.array_except(name, own)) == 0)
        return (share >= coverage) & ((F.size(own) >= least) | ((F.size(own) > 0) & (equal | named)))

    return ~is_blank(quote) & once(words, holds)


def verify_quotes(claims: DataFrame, coverage: float = 0.8, least: int = 3) -> DataFrame:
    """Whether the quote of each claim (quote, evidence_text, search_text, entity_name) is found and long enough: its tokens lie
    in the fact's text, and are ``least`` or more, or all of the evidence, or hold the whole name."""
    return claims.withColumn("verified", quote_stands("quote", "evidence_text", "search_text", "entity_name", coverage, least))
