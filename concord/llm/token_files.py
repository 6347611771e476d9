"""Token-id files: concatenated ids with Elias-Fano document boundaries (operator 2).

A segment is one binary image: a header, the boundaries of its documents as an Elias-Fano code with sampled select, and
the ids in two (or four) bytes each.  Segments are the rows of a Parquet table, so they can lie in any store Spark writes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, pieces, text_column
from .elias_fano import EliasFano, encode
from .word_bpe import word_bpe

#: Ids after which a segment is closed (one longer document makes one longer segment).
SEGMENT_IDS = 2_000_000
_HEAD = struct.Struct("<4sIQQ")
_MAGIC = b"EFT1"
SEGMENT_SCHEMA = "part int, seq int, before long, n_ids long, doc_ids array<long>, image binary"


def pack_segment(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The image of documents with ``counts`` ids each, whose ids stand one after another in ``ids``."""
    ends = np.cumsum(np.asarray(counts, np.int64))
    bounds = encode(np.concatenate([[0], ends]), int(ends[-1]) if len(ends) else 0)
    return _HEAD.pack(_MAGIC, ids.dtype.itemsize, len(ends), len(bounds)) + bounds + ids.tobytes()


class Segment:
    """A read view of an image: ``offsets`` selects boundaries, ``ids`` are the ids of a document."""

    def __init__(self, image: bytes) -> None:
        magic, width, self.n_docs, size = _HEAD.unpack_from(image, 0)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        self.bounds = EliasFano(memoryview(image)[_HEAD.size : _HEAD.size + size])
        self.values = np.frombuffer(image, f"<u{width}", -1, _HEAD.size + size)

    def offsets(self, index: np.ndarray) -> np.ndarray:
        return self.bounds.select(index).astype(np.int64)

    def ids(self, doc: int) -> np.ndarray:
        start, end = self.offsets(np.array([doc, doc + 1]))
        return self.values[start:end]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encode every whole text and write segments in ascending doc_id order; returns the written table of segments.

    Null texts count as empty (one end id), null ids sort first, equal ids are ordered by text, repeated rows are written each,
    a very long text makes a long segment, other columns, also of the names above, are ignored, and an empty table gives no
    segments.  ``part`` and ``seq`` order the segments; ``before`` counts the ids before a
    segment in its part.
    """

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, before = word_bpe(vocabulary), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before
            ids, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            doc_ids = [d for h in held for d in h[2]]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([pack_segment(ids, counts)], pa.binary())],
                ["part", "seq", "before", "n_ids", "doc_ids", "image"],
            )
            seq, before = seq + 1, before + len(ids)
            held.clear()
            return row

        for batch in pieces(batches, most=4 << 20):
            ids, counts = coder.encode(batch.column(1), end_id)
            held.append((ids, counts, batch.column(0).to_pylist()))
            if sum(len(h[0]) for h in held) >= SEGMENT_IDS:
                yield close()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(encode_part, SEGMENT_SCHEMA), "tokens")


def read_tokens(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from written segments: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and,
    if asked for, the ids."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    fields = "doc_id long, local long, n_tokens long, ids_crc32 long, part int" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, doc_ids, image in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                segment = Segment(image.as_buffer())
                bounds = segment.offsets(np.arange(segment.n_docs + 1))
                wide = segment.values.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc_ids), part, np.int32))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    rows = segments.select("part", "before", "doc_ids", "image").mapInArrow(read, fields)
    # one row per written partition: its count is set by the plan, not by the data
    joined = rows.join(F.broadcast(base), "part")
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
