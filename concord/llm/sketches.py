"""Document fingerprints as threshold-scaled sketches (operator 9).

A sketch keeps every distinct shingle hash below a fixed part of the hash range; a text with none keeps its least hash.
The union of two texts has the sketch that ``merge`` makes of theirs, and the shares of common hashes estimate resemblance
and containment, however unequal the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pieces, text_column
from ._words import hash_words, mix, runs, split_words

#: Words in a shingle, and the part 1 / SCALE of all hashes that is kept.
WIDTH = 5
SCALE = 8
#: Bytes of text, and rows, in a range of ids that one task reads in order; and ranges at most (beyond it they grow, and stream).
RANGE_BYTES, RANGE_ROWS, MOST_RANGES = 24 << 20, 200_000, 20_000
_LIMIT = np.uint64((1 << 64) // SCALE)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sketches(text: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted sketch of each whole text; shingles are runs of ``width`` lower-cased words, or all words of a shorter text."""
    doc, words, index = split_words(text)
    hashed = hash_words(words)[index]
    counts = np.bincount(doc, minlength=len(text)).astype(np.int64)
    shingles = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    starts = runs(np.cumsum(counts) - counts, shingles)
    owner = np.repeat(np.arange(len(text)), shingles)
    value = np.zeros(len(starts), np.uint64)
    last = np.cumsum(counts)[owner] - 1
    for k in range(width):
        at = starts + k
        have = at <= last
        value = mix(value * _FACTOR + np.where(have, hashed[np.minimum(at, len(hashed) - 1)], np.uint64(k))) if len(starts) else value
    out: list[np.ndarray] = []
    ends = np.cumsum(shingles)
    keep = value < _LIMIT
    least = np.minimum.reduceat(value, (ends - shingles)[shingles > 0]) if len(value) else value
    least_of = dict(zip(np.flatnonzero(shingles > 0).tolist(), least, strict=True))
    kept, kept_owner = value[keep], owner[keep]
    order = np.lexsort((kept, kept_owner))
    kept, kept_owner = kept[order], kept_owner[order]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = (kept[1:] != kept[:-1]) | (kept_owner[1:] != kept_owner[:-1])
    kept, kept_owner = kept[fresh], kept_owner[fresh]
    bounds = np.searchsorted(kept_owner, np.arange(len(text) + 1))
    for i in range(len(text)):
        mine = kept[bounds[i] : bounds[i + 1]]
        out.append(mine if len(mine) or not shingles[i] else np.array([least_of[i]], np.uint64))
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two texts' shingles."""
    both = np.union1d(a, b)
    below = both[both < _LIMIT]
    return below if len(below) else both[:1]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all (1 for two texts without words)."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return float(np.isin(a, b, assume_unique=True).mean()) if len(a) else 1.0


def to_text(sketch: np.ndarray) -> str:
    """16 hex digits for each hash, in order."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, then by id; the last rows of a range are copies of the next range's first document."""
    held: tuple | None = None  # (range, doc_id, text) of the row that waits for the next
    for batch in pieces(batches, "text", 2 << 20):
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        todo = []
        for row in rows:
            if held is not None and held[0] == row[0] and not held[3]:
                todo.append((held[1], held[2], row[2]))
            held = (row[0], row[1], row[2], row[3])
        if todo:
            yield _rows(todo)


def _rows(todo: list[tuple]) -> pa.RecordBatch:
    edited = []
    for _, own, follower in todo:
        q = len(own) // 4
        edited.append(own[: len(own) - q] + follower[:q])
    # a follower is mostly the next row: each distinct text of the batch is sketched once
    distinct = list(dict.fromkeys([t for _, own, follower in todo for t in (own, follower)] + edited))
    found = dict(zip(distinct, sketches(pa.array(distinct, pa.string())), strict=True))
    texts = {}
    for t in [own for _, own, _ in todo] + edited:
        if t not in texts:
            texts[t] = to_text(found[t])
    columns = [
        [d for d, _, _ in todo],
        [len(own) for _, own, _ in todo],
        [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        [texts[own] for _, own, _ in todo],
        [texts[e] for e in edited],
        [resemblance(found[own], found[e]) for (_, own, _), e in zip(todo, edited, strict=True)],
        [resemblance(found[own], found[follower]) for _, own, follower in todo],
        [containment(found[own], found[e]) for (_, own, _), e in zip(todo, edited, strict=True)],
        [containment(found[own], found[follower]) for _, own, follower in todo],
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(s) for s in sketches(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def compare_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint every whole text, its edited text and the next document's, in ascending doc_id order; ``near_*`` is the likeness of both
    texts, ``contained_*`` the share of the text's own shingles that the other one has, however much longer that is.

    Documents go to ranges of ids of about ``RANGE_BYTES`` of text, each range in id order in one task.  The first document of a
    range goes also to the range before it, as the follower of its last document (that of the first range follows the last
    of all).  Bounds of ranges are ids of documents; they are the only rows that reach the driver.  Null texts are empty,
    null ids come first, equal ids are ordered by text; a lone document follows itself; a very long text is sketched whole;
    an empty table gives no rows; other columns, also of the names above, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    found = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    ranges = ranges or min(MOST_RANGES, max(1, -(-(found["bytes"] or 0) // RANGE_BYTES), found["n"] // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [k / ranges for k in range(1, ranges)]
        q = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(c) for c in cuts)), F.lit(100 * ranges)).alias("q")).first()["q"]
        bounds = sorted({b for b in q or [] if b != found["least"] or found["nulls"]})
    starts, first, last = np.array(bounds, np.int64), None if found["nulls"] else found["least"], len(bounds)

    @F.pandas_udf("array<int>")
    def to_ranges(ids: pd.Series) -> pd.Series:
        """The range of an id, and for the first id of a range the range before it as -1 - range."""
        value, known = ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy()
        own = np.where(known, np.searchsorted(starts, value, "right"), 0)
        head = np.isin(value, starts) & known
        opens = ~known if first is None else known & (value == first)
        return pd.Series([[o] if not (h or z) else [o, -1 - (last if z else o - 1)] for o, h, z in zip(own.tolist(), head.tolist(), opens.tolist(), strict=True)])

    dealt = rows.select("doc_id", "text", F.explode(to_ranges("doc_id")).alias("to"))
    dealt = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), "doc_id", "text", (F.col("to") < 0).alias("copy"))
    ordered = dealt.repartitionById(last + 1, "part").sortWithinPartitions("part", "copy", "doc_id", "text")
    return ordered.mapInArrow(_compare, _FIELDS)
