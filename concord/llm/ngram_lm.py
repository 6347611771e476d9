"""Bigram language model in Elias-Fano tries (operator 5).

Blocks of a few million tokens are the unit of work.  A block names its distinct words and bigrams once; shards of the
vocabulary add up the counts of all blocks, build their part of the trie, and answer each block with its words' counts and
back-off weights and with its bigrams' probabilities, found in the trie; the block then sums the log probabilities of its
texts.  So what is shuffled is a few bytes per distinct bigram of a block (never more rows than these), no task holds more
than its shard or block, and a frequent word comes once a block.

Model: absolute discounting, P(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * P1(w), with T(v) the number of distinct
words after v and P1(w) = (c(w) + 1) / (N + V + 1); after an unseen v it is P1(w).  The end token comes before the first word.
The trie's levels hold the first term (the discounted probability of a successor) and the factor of P1 (the back-off weight of a
context), both quantised in steps of 1/2048 of an octave.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, pieces, text_column
from ._words import hash_words, mix, split_words
from .elias_fano import EliasFano, encode

#: Discount of absolute discounting.
DISCOUNT = 0.75
#: Tokens after which a block is closed, and distinct words and bigrams of blocks that one shard takes on average.
BLOCK_TOKENS = 2_000_000
SHARD_ENTRIES = 600_000
#: A word that makes up more than this part of a shard's mean load is split over shards by the word after it.
HOT_SHARE = 0.05
#: A word that no text can hold: it has a space.
_END = np.uint64(xxhash.xxh64_intdigest(b"\x20end"))
#: Quantisation of probabilities in 16 bits: code 0 is none, code k is 2 to the -(k - 1) / STEPS.
STEPS = 2048
_TRIE = struct.Struct("<QQQQ")

STATE_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, n_tokens array<int>, trained long, distinct long, head array<long>, head_n array<long>, words binary, stream binary"
ASK_SCHEMA = "shard long, block long, words binary, counts binary, contexts binary, sizes binary, nexts binary, pair_counts binary"
ANSWER_SCHEMA = "shard long, block long, counts binary, weights binary, codes binary, n_words long, hot array<long>, hot_followers array<long>"


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities (0 for none): the nearest step of the logarithm."""
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log2(p) * STEPS)
    return np.where(p > 0, 1 + np.minimum(steps, 65534), 0).astype("<u2")


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((1 - codes.astype(np.float64)) / STEPS), 0.0)


def build_trie(contexts: np.ndarray, sizes: np.ndarray, nexts: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> bytes:
    """A two-level trie.  The first level has the sorted context hashes, pointers to their successors and quantised back-off
    weights; the second has the successors in the order of their context (32 bits of their hash) and quantised discounted
    probabilities.  Hashes, pointers and successors are Elias-Fano codes: a successor's value is its context's number and its
    hash, so the level is one increasing sequence.  ``totals`` is the count of each context."""
    pointers = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
    levels = [encode(contexts, 2**64 - 1), encode(pointers, int(pointers[-1])), encode((owner << np.uint64(32)) | nexts, max(1, len(contexts)) << 32)]
    weights = quantise(DISCOUNT * sizes / np.maximum(totals, 1))
    codes = quantise((counts - DISCOUNT) / np.repeat(np.maximum(totals, 1), sizes))
    return _TRIE.pack(*map(len, levels), weights.nbytes) + b"".join(levels) + weights.tobytes() + codes.tobytes()


class Trie:
    """A view of a trie image (bytes or a memory map)."""

    def __init__(self, image) -> None:
        view = memoryview(image)
        *sizes, weights = _TRIE.unpack_from(view, 0)
        at, levels = _TRIE.size, []
        for size in sizes:
            levels.append(EliasFano(view[at : at + size]))
            at += size
        self.contexts, self.pointers, self.successors = levels
        self.weights, self.codes = np.frombuffer(view[at : at + weights], "<u2"), np.frombuffer(view[at + weights :], "<u2")

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """The back-off weight code of each word, 0 if it is no context."""
        at = self.contexts.find(words)
        return np.where(at >= 0, self.weights[at], 0).astype("<u2") if len(self.weights) else np.zeros(len(words), "<u2")

    def find(self, contexts: np.ndarray, sizes: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """The probability code of each bigram, 0 if unseen; ``sizes`` of the ``nexts`` follow each of ``contexts``.

        A context's place in the first level selects two pointers; its successors are searched between them."""
        place = self.contexts.find(contexts)
        begin, end = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        known = np.flatnonzero(place >= 0)
        begin[known], end[known] = self.pointers.select(place[known]), self.pointers.select(place[known] + 1)
        owner, begin, end = (np.repeat(x, sizes) for x in (place, begin, end))
        asked = np.flatnonzero(owner >= 0)
        at = self.successors.find((owner[asked].astype(np.uint64) << np.uint64(32)) | nexts[asked], begin[asked], end[asked])
        out = np.zeros(len(nexts), "<u2")
        out[asked[at >= 0]] = self.codes[at[at >= 0]]
        return out


def _bigrams(stream: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's bigram, as index of the word before << 32 | index of the word; before a text's first stands the end."""
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[first] = stream[np.append(first[1:], len(stream)) - 1]
    return (before.astype(np.int64) << 32) | stream


def _blocks(docs: DataFrame, held: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            hashes, inverse = np.unique(np.concatenate([h for h, _, _, _ in waiting]), return_inverse=True)
            sizes = np.cumsum([0, *(len(h) for h, _, _, _ in waiting)])
            stream = np.concatenate([inverse[sizes[k] : sizes[k + 1]][s] for k, (_, s, _, _) in enumerate(waiting)]).astype("<u4")
            ids, helds = ([x for w in waiting for x in w[k].column(c).to_pylist()] for k, c in ((3, 0), (3, 1)))
            n = np.concatenate([w[2] for w in waiting])
            trained = np.repeat(~np.array(helds, bool), n)
            counts = np.bincount(stream, minlength=len(hashes))
            top = np.argsort(-counts)[:512]
            row = [(part << 24) | seq, ids, helds, n.tolist(), int(trained.sum()), len(hashes) + len(np.unique(_bigrams(stream, np.cumsum(n) - n))), hashes[top].view(np.int64).tolist(), counts[top].tolist(), hashes.tobytes(), zlib.compress(stream.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)]
            seq += 1
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _STATE_ARROW, strict=True)], names=[f.name for f in _STATE_ARROW])

        for batch in pieces(batches, most=4 << 20):
            doc, words, index = split_words(batch.column(2))
            hashes = np.append(hash_words(words), _END)
            n = np.bincount(doc, minlength=batch.num_rows) + 1
            stream = np.full(len(index) + batch.num_rows, len(hashes) - 1, np.int32)
            keep = np.ones(len(stream), bool)
            keep[np.cumsum(n) - 1] = False
            stream[keep] = index
            waiting.append((hashes, stream, n, batch.select([0, 1])))
            if sum(len(w[1]) for w in waiting) >= BLOCK_TOKENS:
                yield close()
        if waiting:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_column(docs).alias("text")).mapInArrow(run, STATE_SCHEMA)


_STATE_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int32())), ("trained", pa.int64()), ("distinct", pa.int64()), ("head", pa.list_(pa.int64())), ("head_n", pa.list_(pa.int64())), ("words", pa.binary()), ("stream", pa.binary())])


def tokens(stream: bytes) -> np.ndarray:
    """The word numbers of a block's tokens."""
    return np.frombuffer(zlib.decompress(stream), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32)


class _Block:
    """A block's tokens and its distinct words and bigrams, with the counts among training texts."""

    def __init__(self, held, n_tokens, words: bytes, stream: bytes) -> None:
        self.words = np.frombuffer(words, np.uint64)
        self.stream = tokens(stream)
        self.n = np.asarray(n_tokens, np.int64)
        self.first = np.cumsum(self.n) - self.n
        trained = np.repeat(~np.asarray(held, bool), self.n)
        self.counts = np.bincount(self.stream[trained], minlength=len(self.words)).astype("<u4")
        self.pairs, self.pair_of = np.unique(_bigrams(self.stream, self.first), return_inverse=True)
        self.pair_counts = np.bincount(self.pair_of[trained], minlength=len(self.pairs)).astype("<u4")

    def shards(self, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each word, and of each bigram: its context's, or by both words after a hot context."""
        of_word = (mix(self.words) % np.uint64(shards)).astype(np.int64)
        context, after = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        of_pair = of_word[context].copy()
        wide = np.isin(self.words, hot)[context]
        of_pair[wide] = (mix(self.words[context[wide]] ^ mix(self.words[after[wide]])) % np.uint64(shards)).astype(np.int64)
        return of_word, of_pair


def _asks(state: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row["held"], row["n_tokens"], row["words"], row["stream"])
                of_word, of_pair = block.shards(shards, hot)
                by_word, by_pair = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
                word_at = np.searchsorted(of_word[by_word], np.arange(shards + 1))
                pair_at = np.searchsorted(of_pair[by_pair], np.arange(shards + 1))
                for s in np.flatnonzero((np.diff(word_at) > 0) | (np.diff(pair_at) > 0)).tolist():
                    words, pairs = by_word[word_at[s] : word_at[s + 1]], by_pair[pair_at[s] : pair_at[s + 1]]
                    contexts, sizes = np.unique(block.pairs[pairs] >> 32, return_counts=True)
                    nexts = (block.words[block.pairs[pairs] & 0xFFFFFFFF] >> np.uint64(32)).astype("<u4")
                    arrays = [block.words[words], block.counts[words], block.words[contexts], sizes.astype("<u4"), nexts, block.pair_counts[pairs]]
                    values = [pa.array([s], pa.int64()), pa.array([row["block"]], pa.int64())]
                    values += [pa.array([_small(a)], pa.binary()) for a in arrays]
                    yield pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in ASK_SCHEMA.split(", ")])

    return state.select("block", "held", "n_tokens", "words", "stream").mapInArrow(run, ASK_SCHEMA)


def _small(values: np.ndarray) -> bytes:
    """Numbers after a mark of their width: counts are mostly of one byte or two."""
    if values.dtype == np.uint64:
        return b"8" + values.tobytes()
    most = int(values.max()) if len(values) else 0
    width = next(w for w in "1248" if most < 1 << (8 * int(w)))
    return width.encode() + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", -1, 1)


def _counted(state: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The count in training texts of each hot word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                trained = np.repeat(~np.asarray(row["held"], bool), row["n_tokens"])
                counts = np.bincount(tokens(row["stream"])[trained], minlength=len(words))
                at = np.minimum(np.searchsorted(words, hot), len(words) - 1)
                mine = np.flatnonzero(words[at] == hot)
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(counts[at[mine]], pa.int64())], names=["at", "n"])

    out = np.zeros(len(hot), np.int64)
    for r in state.select("held", "n_tokens", "words", "stream").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _answer(hot: np.ndarray, hot_counts: np.ndarray):
    """Of one shard: add up all blocks' counts, build the trie, and answer each block from it in the order of its asking."""

    def run(asks: pd.DataFrame) -> pd.DataFrame:
        shard = int(asks["shard"].iloc[0])
        words, counts = (np.concatenate([_wide(b) for b in asks[c]]) for c in ("words", "counts"))
        known, inverse = np.unique(words, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64) if len(known) else np.zeros(0, np.int64)
        contexts = np.concatenate([np.repeat(_wide(c), _wide(s)) for c, s in zip(asks["contexts"], asks["sizes"], strict=True)])
        nexts = np.concatenate([_wide(b) for b in asks["nexts"]]).astype(np.uint64)
        pair_counts = np.concatenate([_wide(b) for b in asks["pair_counts"]]).astype(np.int64)
        names, number = np.unique(contexts, return_inverse=True)
        keys, pair_of = np.unique((number.astype(np.uint64) << np.uint64(32)) | nexts, return_inverse=True)
        summed = np.bincount(pair_of, weights=pair_counts, minlength=len(keys)).astype(np.int64)
        keys, summed = keys[summed > 0], summed[summed > 0]
        owner = (keys >> np.uint64(32)).astype(np.int64)
        sizes, totals = np.bincount(owner, minlength=len(names)), np.bincount(owner, weights=summed, minlength=len(names))
        wide = np.flatnonzero(np.isin(names, hot))  # successors of a hot word lie in many shards
        totals[wide] = hot_counts[np.searchsorted(hot, names[wide])]
        some = sizes > 0
        image = build_trie(names[some], sizes[some], keys & np.uint64(0xFFFFFFFF), summed, totals[some])
        del words, counts, contexts, number, pair_of, pair_counts, keys, owner
        rows = []
        with tempfile.TemporaryFile() as file:  # the levels are read through a map of a nameless file of this task
            file.write(image)
            file.flush()
            del image
            with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as levels:
                trie, at = Trie(levels), 0
                for block, asked, own, size, after in zip(asks["block"], asks["words"], asks["contexts"], asks["sizes"], asks["nexts"], strict=True):
                    asked = _wide(asked)
                    i = inverse[at : at + len(asked)]
                    at += len(asked)
                    codes = trie.find(_wide(own), _wide(size), _wide(after).astype(np.uint64))
                    rows.append((shard, block, _small(total[i]), trie.weigh(asked).tobytes(), codes.tobytes(), 0, None, None))
                del trie
        rows[0] = (*rows[0][:5], int((total > 0).sum()), names[wide].view(np.int64).tolist(), sizes[wide].tolist())
        return pd.DataFrame(rows, columns=[f.split()[0] for f in ANSWER_SCHEMA.split(", ")])

    return run


def _scores(n_all: int, vocabulary: int, shards: int, hot: np.ndarray, hot_weights: np.ndarray):
    """Sum a block's log probabilities from the answers of all shards."""

    def run(states: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(states):
            return pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        row = states.iloc[0]
        block = _Block(row["held"], row["n_tokens"], row["words"], row["stream"])
        of_word, of_pair = block.shards(shards, hot)
        by_word, by_pair = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
        ordered = answers.sort_values("shard")
        counts, weights, codes = np.empty(len(block.words), np.int64), np.empty(len(block.words), "<u2"), np.empty(len(block.pairs), "<u2")
        counts[by_word] = np.concatenate([_wide(c) for c in ordered["counts"]])
        weights[by_word] = np.concatenate([np.frombuffer(w, "<u2") for w in ordered["weights"]])
        codes[by_pair] = np.concatenate([np.frombuffer(c, "<u2") for c in ordered["codes"]])
        if len(hot):
            at = np.minimum(np.searchsorted(hot, block.words), len(hot) - 1)
            weights = np.where(hot[at] == block.words, hot_weights[at], weights)
        lower = (counts + 1.0) / (n_all + vocabulary + 1.0)
        context, after = block.pairs >> 32, block.pairs & 0xFFFFFFFF
        model = dequantise(codes) + dequantise(weights)[context] * lower[after]
        logs = np.log10(np.where(weights[context] > 0, model, lower[after]))
        sums = lambda x: np.add.reduceat(x, block.first)  # noqa: E731  every text has its end token
        return pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64") if None in list(row["doc_ids"]) else row["doc_ids"], "held_out": row["held"], "n_tokens": block.n, "n_known": sums((counts[block.stream] > 0).astype(np.int64)), "base_score": sums(np.log10(lower)[block.stream]), "score": sums(logs[block.pair_of])})

    return run


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from all texts that are not held out, and score every whole text.

    ``held_out`` is a boolean column expression over ``docs``.  Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the model's log10 probability).  Null and empty texts are one end token, repeated
    rows are learnt and scored each, equal texts score alike, a very long text is one block at most, an empty table gives no
    rows, other columns, also of the names above, are ignored.
    """
    spark = docs.sparkSession
    state = materialise(_blocks(docs, held_out), "lm-blocks", "none")
    sizes = state.agg(F.sum("trained").alias("n"), F.sum("distinct").alias("d"), F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
    n_all, entries, tokens = sizes["n"] or 0, sizes["d"] or 0, sizes["t"] or 0
    shards = max(1, -(-entries // SHARD_ENTRIES))
    # hot words: over HOT_SHARE of a shard's mean load; there are at most shards / HOT_SHARE of them
    heads = state.select(F.explode(F.arrays_zip("head", "head_n")).alias("h")).groupBy("h.head").agg(F.sum("h.head_n").alias("n"))
    hot = np.sort(np.array([r["head"] for r in heads.where(F.col("n") > max(1.0, HOT_SHARE * tokens / shards)).collect()], np.int64).view(np.uint64)) if shards > 1 else np.zeros(0, np.uint64)
    hot_counts = _counted(state, hot) if len(hot) else np.zeros(0, np.int64)
    answers = materialise(_asks(state, shards, hot).repartition(shards, "shard").groupBy("shard").applyInPandas(_answer(hot, hot_counts), ANSWER_SCHEMA), "lm-answers", "none")
    vocabulary = answers.agg(F.sum("n_words").alias("v")).first()["v"] or 0
    spread = answers.where(F.col("hot").isNotNull()).select(F.explode(F.arrays_zip("hot", "hot_followers")).alias("h")).groupBy("h.hot").agg(F.sum("h.hot_followers").alias("n"))
    hot_n = {np.int64(r["hot"]).view(np.uint64).item(): r["n"] for r in spread.collect()} if len(hot) else {}
    hot_weights = quantise(DISCOUNT * np.array([hot_n.get(h, 0) for h in hot.tolist()], np.float64) / np.maximum(hot_counts, 1))
    blocks = state.select("block", "doc_ids", "held", "n_tokens", "words", "stream").groupBy("block")
    replies = answers.select("block", "shard", "counts", "weights", "codes").groupBy("block")
    scored = blocks.cogroup(replies).applyInPandas(_scores(n_all, vocabulary, shards, hot, hot_weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
