"""Ranked lexical search over bit-sliced Bloom signatures (operator 13).

The index has one row per block of documents: a Bloom signature of every document, stored by bit position, so that one slice
says for all documents of the block whether they may hold a term.  Terms that occur at least 2 and 4 times are entered under
names of their own as well.  Slices overestimate presence; weighted sums of them bound each document's score from above.
A search reads the index alone, twice: the documents of the highest bounds are scored exactly first, which gives each item a
score that its last hit has at least; then all documents whose bound is not below it are scored exactly.

A document's score depends on whole numbers only, so bounds and scores are exact wherever they are computed.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, pieces, text_column
from ._words import mix, runs, split_words

#: Bits of a signature per entry of its block's fullest document, and slices read per entry.
BITS, HASHES = 12, 4
#: Documents of a block, and bytes of its slices; blocks of long documents have fewer documents, down to 8.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Occurrences from which a term has a further entry.
STEPS = (1, 2, 4)
#: Items that one pass over the index serves, and distinct terms of items that are broadcast to count their documents.
ITEMS, WANTED = 1024, 500_000
TOP = 10
_SEED = 13
#: Bytes that end a term are spaces, A-Z are lower case: ASCII that is no letter or digit.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: pa.Array) -> pa.Array:
    """The texts with every byte outside terms as a space and A-Z in lower case: byte for byte, so the offsets stay."""
    kept = pa.concat_arrays([text]) if text.offset else text
    large = pa.types.is_large_string(kept.type)
    _, offsets, data = kept.buffers()
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(kept), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)))


def term_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(document, term, occurrences) of each document and term, sorted by document; distinct terms; terms of each document."""
    doc, terms, index = split_words(folded(text), lower=False)
    pair, tf = np.unique(doc.astype(np.int64) * max(1, len(terms)) + index, return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), tf.astype(np.int64), terms, np.bincount(doc, minlength=len(text)).astype(np.int64)


def hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, _SEED) for t in terms.cast(pa.binary()).to_pylist()), np.uint64, len(terms))


def places(h: np.ndarray, step: int, bits: int) -> np.ndarray:
    """The slices of each hash for one step: HASHES columns."""
    first = mix(h ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    low, high = first & np.uint64(0xFFFFFFFF), (first >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def term_share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The contract's whole-number weight of ``tf`` occurrences in a document of norm ``m``; grows with tf."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int

    def norms(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n * self.documents // max(1, self.terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def _signatures(ids: pa.Array, text: pa.Array) -> Iterator[tuple]:
    """(document ids, terms, most occurrences of one term, bits, slices) of blocks of the batch's documents, short ones first."""
    doc, term, tf, terms, n = term_counts(text)
    h = hashes(terms)
    entries = np.zeros(len(text), np.int64)
    for step in STEPS:
        entries += np.bincount(doc[tf >= step], minlength=len(text))
    most = np.zeros(len(text), np.int64)
    np.maximum.at(most, doc, tf)
    first = np.searchsorted(doc, np.arange(len(text) + 1))
    order = np.argsort(entries, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        size = min(BLOCK, len(order) - at)
        while size > 8 and BITS * int(entries[order[at + size - 1]]) * size // 8 > BLOCK_BYTES:
            size = max(8, size // 2)
        chosen = order[at : at + size]
        bits = max(64, BITS * int(entries[chosen].max()))
        width = -(-size // 8)
        slices = np.zeros((bits, width), np.uint8)
        counts = first[chosen + 1] - first[chosen]
        rows, row = runs(first[chosen], counts), np.repeat(np.arange(size), counts)
        for step in STEPS:
            have = tf[rows] >= step
            where = places(h[term[rows[have]]], step, bits)
            at_byte = where * width + (row[have] >> 3)[:, None]
            np.bitwise_or.at(slices.reshape(-1), at_byte.reshape(-1), np.repeat((128 >> (row[have] & 7)).astype(np.uint8), HASHES))
        yield ids.take(pa.array(chosen)), n[chosen], most[chosen], bits, slices.tobytes()
        at += size


def build_index(docs: DataFrame) -> DataFrame:
    """The signature index, written to the shared folder: (ids, lengths, most, bits, slices), one row per block of documents.

    Documents without a term are not in it.  It takes about a tenth of the bytes of the texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            for ids, n, most, bits, slices in _signatures(batch.column(0), batch.column(1)):
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([whole(ids), whole(pa.array(n, pa.int64())), whole(pa.array(most, pa.int64())), pa.array([bits], pa.int64()), pa.array([slices], pa.binary())], names=["ids", "lengths", "most", "bits", "slices"])

    rows = docs.select("doc_id", text_column(docs).alias("text"))
    return materialise(rows.mapInArrow(run, f"ids array<{kind}>, lengths array<bigint>, most array<bigint>, bits bigint, slices binary"), "signatures")


def corpus_of(index: DataFrame) -> Corpus:
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    row = index.agg(F.sum(F.size("lengths")).alias("documents"), F.sum(total).alias("terms")).first()
    return Corpus(int(row["documents"] or 0), int(row["terms"] or 0))


def document_frequencies(docs: DataFrame, wanted: DataFrame, most: int = WANTED) -> DataFrame:
    """(term, df) of the ``wanted`` terms, of one scan of the texts.

    Up to ``most`` distinct terms go to the tasks, which count only those; with more, tasks count all terms and a join picks.
    """
    few = [r["term"] for r in wanted.select("term").distinct().limit(most + 1).collect()]
    only = pa.array(few, pa.string()) if len(few) <= most else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in pieces(batches, "text", 8 << 20):
            _, term, _, terms, _ = term_counts(batch.column(0))
            counts = np.bincount(term, minlength=len(terms))
            if only is not None:
                keep = pc.is_in(terms, value_set=only).to_numpy(zero_copy_only=False)
                terms, counts = terms.filter(pa.array(keep)), counts[keep]
            held.update(dict(zip(terms.to_pylist(), counts.tolist(), strict=True)))
            if len(held) > most:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])

    counted = docs.select(text_column(docs).alias("text")).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return counted.join(wanted.select("term").distinct(), "term", "left_semi")


class Weights:
    """Items of one pass: their terms' hashes and weights; sent to tasks, at most ITEMS items."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]]) -> None:
        self.numbers = [item for item, _, _ in items]
        distinct = sorted({t for _, terms, _ in items for t in terms})
        code = {t: k for k, t in enumerate(distinct)}
        self.hashes = hashes(pa.array(distinct, pa.string()))
        self.terms = [np.array([code[t] for t in terms], np.int64) for _, terms, _ in items]
        self.weights = [np.array(w, np.int64) for _, _, w in items]

    def bounds(self, bits: int, slices: bytes, documents: int, most: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item position, upper bound of the score of every document of the block) for each item."""
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        steps = []
        for step in STEPS:
            rows = np.bitwise_and.reduce(table[places(self.hashes, step, bits)], axis=1)
            steps.append(steps[-1] & rows if steps else rows)
        # at step k a term counts as with the most occurrences that step k + 1 excludes
        ceilings = [np.minimum(most, following - 1) for following in STEPS[1:]] + [most]
        shares = [term_share(np.maximum(c, 1), m) for c in ceilings]
        gains = [shares[0]] + [np.maximum(0, b - a) for a, b in zip(shares, shares[1:], strict=False)]
        for k, (terms, weights) in enumerate(zip(self.terms, self.weights, strict=True)):
            # sums of weights are below 2**24, so single precision holds them exactly
            w = weights.astype(np.float32)
            held = (np.unpackbits(rows[terms], axis=1, count=documents).astype(np.float32) for rows in steps)
            yield k, sum(gain * (w @ bits_of).astype(np.int64) for gain, bits_of in zip(gains, held, strict=True))


def _highest(index: DataFrame, corpus: Corpus, weights: Weights, k: int) -> DataFrame:
    """(item, doc_id) of the k documents with the highest bounds of each item."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = defaultdict(list)
        count = 0
        for batch in batches:
            for ids, n, most, bits, slices in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = corpus.norms(np.array(n, np.int64))
                for item, bound in weights.bounds(bits, slices, len(ids), np.array(most, np.int64), m):
                    for d in np.argpartition(-bound, min(k, len(bound) - 1))[:k]:
                        if bound[d] > 0:
                            count += 1
                            entry = (int(bound[d]), count, ids[d])
                            (heapq.heappush if len(best[item]) < k else heapq.heappushpop)(best[item], entry)
        rows = [(weights.numbers[item], b, d) for item, found in best.items() for b, _, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["item", "bound", "doc_id"])

    found = index.select("ids", "lengths", "most", "bits", "slices").mapInArrow(run, f"item bigint, bound bigint, doc_id {kind}")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))).where(F.col("n") <= k).select("item", "doc_id")


def _not_excluded(index: DataFrame, corpus: Corpus, weights: Weights, least: dict[int, int]) -> DataFrame:
    """(item, doc_id) of all documents whose bound is not below the item's ``least`` score."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, most, bits, slices in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = corpus.norms(np.array(n, np.int64))
                for item, bound in weights.bounds(bits, slices, len(ids), np.array(most, np.int64), m):
                    number = weights.numbers[item]
                    over = np.flatnonzero(bound >= max(1, least.get(number, 1)))
                    if len(over):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(over), number), pa.int64()), pa.array([ids[d] for d in over])], names=["item", "doc_id"])

    return index.select("ids", "lengths", "most", "bits", "slices").mapInArrow(run, f"item bigint, doc_id {kind}")


def _scored(docs: DataFrame, candidates: DataFrame, corpus: Corpus, items: list[tuple[int, list[str], list[int]]], broadcast_rows: int = 200_000) -> DataFrame:
    """(item, doc_id, score) of the candidates, exactly, from their whole texts.

    Documents meet their list of items by broadcast up to ``broadcast_rows`` listed documents, else by a shuffle.
    """
    by_document = materialise(candidates.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("items")), "candidates")
    hint = "broadcast" if by_document.count() <= broadcast_rows else "merge"
    rows = docs.select("doc_id", text_column(docs).alias("text")).join(by_document.hint(hint), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "items")
    weights_of = {number: dict(zip(terms, weights, strict=True)) for number, terms, weights in items}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            doc, term, tf, terms, n = term_counts(batch.column(1))
            first = np.searchsorted(doc, np.arange(len(n) + 1))
            names, m = terms.to_pylist(), corpus.norms(n)
            lists, ids, out = batch.column(2).to_pylist(), batch.column(0), []
            for d, wanted in enumerate(lists):
                part = slice(first[d], first[d + 1])
                share = dict(zip((names[t] for t in term[part]), term_share(tf[part], m[d]).tolist(), strict=True))
                out += [(item, d, sum(w * share[t] for t, w in weights_of[item].items() if t in share)) for item in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), ids.take(pa.array([r[1] for r in out])), pa.array([r[2] for r in out], pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint").where(F.col("score") > 0)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents with a score above 0 of each item; equal scores by ascending doc_id.

    ``index`` is ``build_index(docs)``, made here if it is not given.  Items are served in passes of ``ITEMS``.  A null or empty
    text has no term: such a document is found by nothing, such an item finds nothing.  Rows that repeat a doc_id are documents of
    their own, rows without an id rank after their equals; rows that repeat an item_id are items of their own under one number
    with ranks of their own; a very long text is read whole; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    corpus = corpus_of(index)
    kind = items.schema["item_id"].dataType.simpleString()
    text = F.translate(text_column(items), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.array_distinct(F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != ""))
    numbered = materialise(items.select("item_id", parts.alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = numbered.select("item", F.explode("terms").alias("term"))
    frequencies = materialise(document_frequencies(docs, wanted), "frequencies")
    listed = materialise(wanted.join(frequencies, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "item-terms")
    out = spark.createDataFrame([], f"item bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint, rank int")
    passes = -(-listed.count() // ITEMS)
    cuts = sorted(set(listed.approxQuantile("item", [k / passes for k in range(1, passes)], 0.1 / passes))) if passes > 1 else []
    for low, high in zip([0, *cuts], [*cuts, (1 << 63) - 1], strict=True):
        chosen = [(r["item"], [t["term"] for t in r["terms"]], [corpus.weight(t["df"]) for t in r["terms"]]) for r in listed.where((F.col("item") >= low) & (F.col("item") < high)).collect()]
        weights = Weights(chosen)
        sure = _ranked(_scored(docs, _highest(index, corpus, weights, top), corpus, chosen), top)
        least = {r["item"]: r["least"] for r in sure.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == top).collect()}
        found = _ranked(_scored(docs, _not_excluded(index, corpus, weights, least), corpus, chosen), top)
        out = out.unionByName(materialise(found, "hits"))
    return out.join(numbered.select("item", "item_id"), "item").select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL of the contract.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total GROUP BY term, documents
), scored AS (
  SELECT q.item_id, tf.doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * n.n * total.documents) // total.terms))))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN n ON n.doc_id = tf.doc_id, total
  GROUP BY q.item_id, tf.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
