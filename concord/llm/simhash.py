"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, pieces, text_column
from .components import connected_components

BITS = 64
#: Distinct fingerprints in a bucket up to which they are compared directly; larger buckets take the exact one-bit way.
DIRECT = 256


def covering_masks(radius: int = 2) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any two words within ``radius`` bits agree on all bits of at least one mask.

    Bit i has a non-zero vector of radius + 1 binary digits.  Mask v keeps bit i if its vector has odd product with v.  The
    vectors of ``radius`` differing bits cannot span all digits, so some v is orthogonal to them all and drops those bits.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprints(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each UTF-8 text: the majority, bit by bit, over the XXH64 of its word shingles; ties and no words give 0."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z, and only ASCII white space
        if not words:
            continue
        before = len(hashes)
        if len(words) < width:
            hashes.append(digest(b" ".join(words), seed))
        else:
            hashes += [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)), strict=False)]
        counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    have = np.flatnonzero(counts)
    if len(have):
        values = np.array(hashes, np.uint64)
        starts = np.cumsum(counts[have]) - counts[have]
        for bit in range(BITS):
            ones = np.add.reduceat((values >> np.uint64(bit) & np.uint64(1)).astype(np.int32), starts)
            out[have] |= (2 * ones > counts[have]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, row: Column | None = None) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text, and the binary ``row`` if given; null texts have no
    words."""
    names = ["doc_id", "fp"] + ["row"] * (row is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            found = text_fingerprints(batch.column(1).cast(pa.binary()).to_pylist(), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")] + ([] if row is None else [row.alias("row")])
    return docs.select(*columns).mapInArrow(run, "doc_id long, fp long" + ", row binary" * (row is not None))


def _close_in_bucket(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From each list of fingerprints, an edge from each to the least one that it reaches within the list."""
    for batch in batches:
        a, b = [], []
        for row in batch.column(0):
            x = np.sort(row.values.to_numpy())
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            label = np.arange(len(x))
            while True:
                new = np.where(near, label[None, :], len(x)).min(1)
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(x)))
            a.append(x[moved])
            b.append(x[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (a, b)], names=["a", "b"])


def near_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as all links of 2 or fewer bits among distinct fingerprints ``fp``.

    Every pair within the radius shares a bucket of some covering mask.  Buckets of up to ``DIRECT`` fingerprints are
    compared directly.  In a larger one each fingerprint names itself and its one-bit changes outside the mask: two within
    the radius name a common word, and all that name a word are within the radius, so no pairs are formed and nothing is
    cut off.
    """
    masks = covering_masks(2)
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)))).alias("x")).select("x.t", "x.k", "fp")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, ["t", "k"]), "buckets")
    lists = shared.where(F.col("n") <= DIRECT).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    direct = lists.mapInArrow(lambda batches: _close_in_bucket(batches, 2), "a long, b long")
    free = [F.array(*(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1), F.lit(0).cast("long")) for m in masks]
    flips = free[0]
    for t in range(1, len(masks)):
        flips = F.when(F.col("t") == t, free[t]).otherwise(flips)
    named = shared.where(F.col("n") > DIRECT).select("t", "k", "fp", F.explode(flips).alias("flip")).select("t", "k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    # at most one more member than free bits
    groups = named.groupBy("t", "k", "word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    hot = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")
    return direct.unionByName(hot).distinct()


def _components(nodes: DataFrame) -> DataFrame:
    """``nodes`` (one row per ``fp``) with ``component``, the name of the fingerprints that links of 2 or fewer bits reach."""
    linked = connected_components(near_edges(nodes.select("fp")))
    return nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (least doc_id reachable) of every document.

    Documents with equal fingerprints are one node, so copies never form pairs; texts without words share the fingerprint
    zero and link like any other.  Repeated rows are returned each; a null doc_id is never a component's name unless all ids
    of the component are null; a very long text is read whole; an empty table gives no rows; other columns, also of the names
    above, are ignored.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    named = _components(nodes)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    names = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    out = prints.join(names, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _row_hash(docs: DataFrame) -> Column:
    """SHA-256 of a row: of its text's bytes and of its other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return F.unhex(F.sha2(F.to_json(F.struct(F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("text"), *others)), 256))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the least by doc_id (nulls last), fingerprint and row hash.

    Components are of fingerprints alone, so documents without an id, or with one id, are told apart by their texts.  Only
    row hashes are grouped; equal rows are reduced to one in each task before the texts are shuffled.  Texts without words are
    one component; the columns may have any names; an empty table stays empty.
    """
    prints = fingerprints(docs, row=_row_hash(docs))
    nodes = materialise(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")), "nodes")
    best = F.min(F.struct("best.no_id", "best.doc_id", "fp", "best.row"))
    kept = _components(nodes).groupBy("component").agg(best.alias("best")).select(F.col("best.row").alias("hash"))
    keyed = docs.select(_row_hash(docs).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = keyed.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("hash"))).where("n = 1")
    return single.join(kept, "hash", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
