"""Best-fit packing of documents into sequences by exact-complement hashing (operator 8)."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import numbered, pieces, rank_in_key, text_column
from .word_bpe import word_bpe

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Encode every whole text (null: empty), append the end id, and cut only documents of over ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(vocabulary)
        for batch in pieces(batches, most=4 << 20):
            ids, counts = coder.encode(batch.column(1), end_id)
            per = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, counts[doc] - start)
            wide = ids.astype("<u4")
            at = (np.cumsum(counts) - counts)[doc] + start
            crcs = [zlib.crc32(wide[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences use each, from the number of pieces of each length.

    Longest lengths first, each is completed by an exact complement while stocks last: one length that fills the gap, then a
    pair, then a triple, found by hashing sums of the lengths in stock.  What has no exact complement is filled by best
    fit.  The work depends on the number of distinct lengths (at most ``capacity``), not on the number of pieces.
    """
    stock = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        stock[length] = n
    # sets of lengths in stock as bits of an integer: bit x, and bit capacity - x
    here = sum(1 << x for x in range(1, capacity + 1) if stock[x])
    mirror = sum(1 << (capacity - x) for x in range(1, capacity + 1) if stock[x])
    patterns: list[tuple[list[int], int]] = []

    def take(x: int, n: int) -> None:
        nonlocal here, mirror
        stock[x] -= n
        if n > 0 and not stock[x]:
            here ^= 1 << x
            mirror ^= 1 << (capacity - x)
        elif n < 0 and stock[x] == -n:
            here ^= 1 << x
            mirror ^= 1 << (capacity - x)

    def pair(gap: int) -> list[int]:
        """The most even pair in stock that sums to ``gap``: short lengths are kept for later gaps."""
        if gap < 2:
            return []
        if not gap % 2 and stock[gap // 2] > 1:
            return [gap // 2, gap // 2]
        both = here & (mirror >> (capacity - gap)) & ((1 << ((gap + 1) // 2)) - 1)
        low = both.bit_length() - 1
        return [gap - low, low] if low > 0 else []

    def triple(gap: int) -> list[int]:
        thirds = here & ((1 << (gap // 3 + 1)) - 1)
        while thirds:
            third = thirds.bit_length() - 1
            thirds ^= 1 << third
            take(third, 1)
            found = pair(gap - third)
            take(third, -1)
            if found:
                return [*found, third]
        return []

    def best_fit(room: int) -> list[int]:
        out: list[int] = []
        while fits := here & ((1 << (room + 1)) - 1):
            best = fits.bit_length() - 1
            take(best, 1)
            out.append(best)
            room -= best
        for x in out:
            take(x, -1)
        return out

    for length in range(capacity, 0, -1):
        while stock[length]:
            gap = capacity - length
            take(length, 1)
            rest = ([gap] if stock[gap] else pair(gap) or triple(gap) or best_fit(gap)) if gap else []
            take(length, -1)
            need: dict[int, int] = defaultdict(int)
            for x in (length, *rest):
                need[x] += 1
            n = min(stock[x] // k for x, k in need.items())
            for x, k in need.items():
                take(x, n * k)
            patterns.append(([length, *rest], n))
    return patterns


class _Places:
    """Where the rank-th piece of each length goes."""

    def __init__(self, patterns: list[tuple[list[int], int]]) -> None:
        seen: dict[int, int] = defaultdict(int)
        rows = []
        sequence = 0
        for lengths, n in patterns:
            offsets = np.cumsum([0, *lengths[:-1]])
            slots = defaultdict(list)
            for x, o in zip(lengths, offsets.tolist(), strict=True):
                slots[x].append(o)
            for x, places in slots.items():
                rows.append((x, seen[x], sequence, places))
                seen[x] += n * len(places)
            sequence += n
        rows.sort()
        self.length, self.first, self.sequence, places = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        self.places = places
        self.length, self.first = np.array(self.length, np.int64), np.array(self.first, np.int64)
        self.sequence, self.k = np.array(self.sequence, np.int64), np.array([len(p) for p in places], np.int64)
        self.at = np.cumsum(self.k) - self.k
        self.offsets = np.array([o for p in places for o in p], np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), np.int64)
        for x in np.unique(length):
            mine = length == x
            low, high = np.searchsorted(self.length, [x, x + 1])
            row[mine] = low + np.searchsorted(self.first[low:high], rank[mine], "right") - 1
        inside = rank - self.first[row]
        return self.sequence[row] + inside // self.k[row], self.offsets[self.at[row] + inside % self.k[row]]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Only the count of each length (at most
    ``capacity`` numbers) reaches the driver; pieces find their places by their rank among pieces of equal length.  Null
    texts are one end id, repeated rows are packed apart, a very long text is cut into many pieces, an empty table gives no
    rows, other columns, also of the names above, are ignored.
    """
    cut = numbered(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _Places(plan_packing(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = rank_in_key(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", max(counts.values(), default=0))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
