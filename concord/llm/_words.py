"""Vectorised words of Arrow text batches, and gathers of variable-length runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (document of each word, distinct words, index of each word)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    doc = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(ends))
    coded = flat.dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # white space at an end leaves an empty word
        keep = ~empty[index]
        doc, index = doc[keep], index[keep]
        moved = np.cumsum(~empty) - 1
        index, words = moved[index].astype(np.int32), words.filter(pa.array(~empty))
    return doc, words, index


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each distinct word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all runs, one after another."""
    total = int(lengths.sum(dtype=np.int64))
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    ends = np.cumsum(lengths, dtype=np.int64)
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
