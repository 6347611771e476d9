"""Shared tokens of texts: every golden text against every fact, by blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: A rounded ratio may pass what the exact one does not.
SLACK = 2e-6


def shared_tokens(golden: DataFrame, facts: DataFrame, ratio: Callable, floor: float, best: bool = False, golden_block: int = 1024, fact_block: int = 4096) -> DataFrame:
    """(golden_id, fact_id, shared, n_golden, n_fact): how many distinct tokens a golden text (golden_id, golden_text) and a fact
    (fact_id, fact_text) share, for all pairs whose ``ratio`` of these three numbers reaches ``floor`` (positive; a little below it too).

    With ``best`` only the pairs that can be the best of a golden text by the ratio rounded to six places: of equal ratios in a block the
    least fact.  Each text is tokenised once and dealt whole; a pair of blocks meets in one task and adds up its counts in a
    matrix, so common tokens never spread to pairs in a shuffle.
    """
    kinds = dict(golden.dtypes)["golden_id"], dict(facts.dtypes)["fact_id"]
    n_g, n_f = max(1, -(-golden.count() // golden_block)), max(1, -(-facts.count() // fact_block))
    g = golden.select("golden_id", F.array_distinct(tokens("golden_text")).alias("t")).where("size(t) > 0")
    f = facts.select("fact_id", F.array_distinct(tokens("fact_text")).alias("t")).where("size(t) > 0")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"golden_id": left["golden_id"].slice(0, 0), "fact_id": right["fact_id"].slice(0, 0), **{c: pa.array([], pa.int32()) for c in ("shared", "n_golden", "n_fact")}})
        right = right.take(pc.sort_indices(right["fact_id"]))
        (own, rows, n), (held, columns, m) = _flat(left["t"]), _flat(right["t"])
        terms = own.unique()
        at, to = pc.index_in(own, terms).to_numpy(), pc.index_in(held, terms).fill_null(-1).to_numpy()
        columns, to = columns[to >= 0], to[to >= 0]
        rows, columns = rows[np.argsort(at, kind="stable")], columns[np.argsort(to, kind="stable")]
        mine, theirs = (np.append(0, np.cumsum(np.bincount(x, minlength=len(terms)))) for x in (at, to))
        shared = np.zeros((len(left), len(right)), np.int32)
        for k in np.flatnonzero(np.diff(theirs)).tolist():  # a text names each of its tokens once
            shared[np.ix_(rows[mine[k] : mine[k + 1]], columns[theirs[k] : theirs[k + 1]])] += 1
        value = ratio(shared, n[:, None], m[None, :])
        least = np.maximum(floor, value.max(1, keepdims=True)) if best else floor
        i, j = np.nonzero(value >= least - SLACK)
        if best:
            _, first = np.unique(np.stack([i, value[i, j]], 1), axis=0, return_index=True)
            i, j = i[first], j[first]
        out = {"golden_id": left["golden_id"].take(pa.array(i)), "fact_id": right["fact_id"].take(pa.array(j))}
        return pa.table(out | {"shared": pa.array(shared[i, j], pa.int32()), "n_golden": pa.array(n[i], pa.int32()), "n_fact": pa.array(m[j], pa.int32())})

    dealt = lambda df, key, own, k, other, l: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(k)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(l - 1))))  # noqa: E731, E741
    pairs = dealt(g, "golden_id", "gb", n_g, "fb", n_f).groupBy("gb", "fb").cogroup(dealt(f, "fact_id", "fb", n_f, "gb", n_g).groupBy("gb", "fb"))
    return pairs.applyInArrow(count, f"golden_id {kinds[0]}, fact_id {kinds[1]}, shared int, n_golden int, n_fact int")


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of lists, the list of each, and the length of each list."""
    whole = lists.combine_chunks()
    n = pc.list_value_length(whole).to_numpy()
    return whole.flatten(), np.repeat(np.arange(len(n)), n), n
