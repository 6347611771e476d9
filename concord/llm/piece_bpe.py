"""SentencePiece encoding and decoding by vectorised merge rounds (operator 3).

The vocabulary is read from the model file with the sentencepiece library; encoding and decoding are numpy.  A batch of
texts is cut where no piece can reach across, each distinct cut is merged once, and the ids of whole texts are gathered.

Inside, a cut falls into units between neighbouring characters that no piece holds side by side, so that a long token without
spaces is merged in time close to its length.  In a round every unit looks up the rank of each adjacent pair, takes its least rank, and merges all its pairs of that
rank from the left, skipping overlaps; units without a pair leave.  One merge at a time gives the same, except where a merge
makes a pair of better rank than its own; for the few ranks where the vocabulary allows that, only the leftmost pair merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pieces, text_column
from ._words import runs

SPACE = "▁"
#: The rank of a pair that forms no piece.
_NONE = np.int32(2**31 - 1)
#: Distinct cuts that a Python worker keeps; the cache starts anew beyond it.
CACHE_CUTS = 500_000


class PieceBpe:
    """Encoder and decoder of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.full(256, self.unk, np.int32)
        kinds = np.zeros(self.size, np.int8)  # 0 text, 1 control, 2 byte, 3 unknown
        plain: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_control(i):
                kinds[i] = 1
            elif model.is_unknown(i):
                kinds[i] = 3
            elif model.is_byte(i):
                kinds[i] = 2
                self.byte_ids[int(name[3:5], 16)] = i
            else:
                plain[name] = i
        self.kinds = kinds
        self.has_bytes = bool((kinds == 2).sum() == 256)
        # a symbol is a piece id, or beyond the vocabulary a code point that is no piece of its own
        self.piece_of_char = np.full(0x110000, -1, np.int32)
        for name, i in plain.items():
            if len(name) == 1:
                self.piece_of_char[ord(name)] = i
        order = sorted((-model.get_score(i), i) for i in plain.values())
        rank = np.full(self.size, _NONE, np.int32)
        for at, (_, i) in enumerate(order):
            rank[i] = at
        self.id_of_rank = np.array([i for _, i in order], np.int32)
        symbol = lambda s: plain.get(s, -1) if len(s) > 1 else (plain.get(s) if s in plain else self.size + ord(s))
        keys, ranks, better = [], [], set()
        for name, i in plain.items():
            for k in range(1, len(name)):
                left, right = symbol(name[:k]), symbol(name[k:])
                if left is not None and right is not None and left >= 0 and right >= 0:
                    keys.append((left << 32) | right)
                    ranks.append(rank[i])
                    better |= {x for x in (left, right) if x < self.size and rank[x] > rank[i]}
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[by_key], np.array(ranks, np.int32)[by_key]
        self.alone = np.zeros(len(order), bool)
        self.alone[[rank[i] for i in better]] = True
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._slot(self.keys)] = True
        # no piece holds a space mark after another character: texts may be cut before each run of marks
        if any(SPACE in n.lstrip(SPACE) for n in plain):
            raise ValueError("this vocabulary has pieces across words")
        beside = {(ord(a) << 32) | ord(b) for n in plain for a, b in zip(n, n[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.int64)
        self.newline_alone = not any("\n" in n for n in plain)
        shown = [n.replace(SPACE, " ").encode() if kinds[i] == 0 else bytes([int(n[3:5], 16)]) if kinds[i] == 2 else b"" if kinds[i] == 1 else " ⁇ ".encode() for i, n in enumerate(names)]
        self.lengths = np.fromiter(map(len, shown), np.int32, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), _NONE, np.int32)
        maybe = np.flatnonzero(self.filter[self._slot(keys)])
        if len(maybe):
            wanted = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            out[maybe[hit]] = self.ranks[at[hit]]
        return out

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece holds two characters side by side."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        return self.beside[at] == keys

    def _merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over cuts of ``counts`` symbols each; returns the final symbols of all cuts and their counts."""
        n = len(counts)
        done_words: list[np.ndarray] = []
        done_symbols: list[np.ndarray] = []
        done_counts: list[np.ndarray] = []
        words = np.arange(n)
        pair = np.full(len(symbols), _NONE, np.int32)  # rank of the pair that begins at each symbol
        if len(symbols):
            pair[:-1] = self._rank(symbols[:-1], symbols[1:])
            pair[np.cumsum(counts) - 1] = _NONE
        while len(words):
            starts = np.cumsum(counts) - counts
            least = np.minimum.reduceat(pair, starts)
            over = least == _NONE
            if over.any():
                keep = np.repeat(~over, counts)
                done_words.append(words[over])
                done_counts.append(counts[over])
                done_symbols.append(symbols[~keep])
                symbols, pair, words, counts, least = symbols[keep], pair[keep], words[~over], counts[~over], least[~over]
                if not len(words):
                    break
                starts = np.cumsum(counts) - counts
            of_word = np.repeat(np.arange(len(words), dtype=np.int32), counts)
            hit = np.flatnonzero(pair == least[of_word])
            # of each run of overlapping pairs take every second one, from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = np.diff(hit) != 1
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - first) % 2 == 0
            lone = self.alone[pair[hit]]
            if lone.any():
                w = of_word[hit]
                leftmost = np.ones(len(hit), bool)
                leftmost[1:] = w[1:] != w[:-1]
                take &= ~lone | leftmost
            hit = hit[take]
            symbols[hit] = self.id_of_rank[pair[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            counts = counts - np.bincount(of_word[hit], minlength=len(words))
            touched = np.zeros(len(symbols), bool)
            touched[hit] = True
            kept = ~gone
            symbols, pair, touched = symbols[kept], pair[kept], touched[kept]
            # pairs that begin at or just before a merged symbol are looked up again
            again = touched.copy()
            again[:-1] |= touched[1:]
            ends = np.cumsum(counts) - 1
            again[ends] = False
            at = np.flatnonzero(again)
            pair[at] = self._rank(symbols[at], symbols[at + 1])
            pair[ends] = _NONE
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        all_words, all_counts, all_symbols = np.concatenate(done_words), np.concatenate(done_counts), np.concatenate(done_symbols)
        begin = np.cumsum(all_counts) - all_counts
        back = np.argsort(all_words)
        return all_symbols[runs(begin[back], all_counts[back])], all_counts[back]

    def _learn(self, cuts: list[str]) -> None:
        if len(self.known) + len(cuts) > CACHE_CUTS:  # then ``cuts`` are all that the batch needs
            self.known.clear()
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        own = self.piece_of_char[points]
        symbols = np.where(own >= 0, own, self.size + points).astype(np.int32)
        units = np.zeros(len(points), bool)  # where a unit begins
        units[np.cumsum(counts) - counts] = True
        units[1:] |= ~self._side_by_side(points[:-1], points[1:])
        begins = np.flatnonzero(units)
        symbols, sizes = self._merge(symbols, np.diff(np.append(begins, len(points))))
        counts = np.add.reduceat(sizes, np.searchsorted(begins, np.cumsum(counts) - counts))
        odd = symbols >= self.size
        if odd.any():  # characters of no piece: their bytes, or else unknown
            spelled = [self.byte_ids[list(chr(c - self.size).encode("utf-8", "surrogatepass"))] if self.has_bytes else np.array([self.unk]) for c in symbols[odd].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = [len(s) for s in spelled]
            ids = np.repeat(symbols, sizes)
            ids[np.repeat(odd, sizes)] = np.concatenate(spelled)
            counts = np.add.reduceat(sizes, np.cumsum(counts) - counts)
            symbols = ids
        data = symbols.astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        self.known.update(zip(cuts, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def encode(self, text: pa.Array, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        cut_lists = [_cuts(t, self.newline_alone) for t in text.to_pylist()]
        counts = np.fromiter(map(len, cut_lists), np.int64, len(cut_lists))
        flat = pa.array([c for cuts in cut_lists for c in cuts], pa.string()).dictionary_encode()
        listed, index = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        missing = [c for c in listed if c not in self.known]
        if missing:
            if len(self.known) + len(missing) > CACHE_CUTS:
                missing = listed
            self._learn(missing)
        known = self.known
        coded = [known[c] for c in listed]
        sizes = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        values = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[index]
        doc = np.repeat(np.arange(len(counts)), counts)
        lengths = np.bincount(doc, weights=each, minlength=len(counts)).astype(np.int64)
        ids = values[runs(begin[index], each)]
        extra = int(bos) + int(eos)
        out = np.empty(len(ids) + extra * len(counts), "<u4")
        keep = np.ones(len(out), bool)
        ends = np.cumsum(lengths + extra)
        if bos:
            keep[ends - lengths - extra] = False
            out[ends - lengths - extra] = self.bos
        if eos:
            keep[ends - 1] = False
            out[ends - 1] = self.eos
        out[keep] = ids
        return out, lengths + extra

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids: marks become spaces, the first one of a text goes, control ids are silent,
        bytes that form no character become U+FFFD."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        data = self.shown[runs(self.starts[ids], lengths)].tobytes()
        ends = np.cumsum(lengths.astype(np.int64))
        last = np.cumsum(counts)
        first = last - counts
        before = np.concatenate([[0], ends])
        a, b = before[first].tolist(), before[last].tolist()
        kinds = self.kinds[ids]
        has_byte = np.zeros(len(counts), bool)
        has_byte[np.searchsorted(last, np.flatnonzero(kinds == 2), "right")] = True
        silent = np.cumsum(np.concatenate([[0], kinds == 1]))
        out = []
        for i in range(len(counts)):
            mine = slice(first[i], last[i])
            part = data[a[i] : b[i]]
            inside = silent[max(first[i], last[i] - 1)] - silent[min(first[i] + 1, last[i])]  # control ids end a run of bytes
            if has_byte[i] and (inside > 0 or not _valid(part)):
                out.append(self._decode_slowly(ids[mine]))
                continue
            spoken = np.flatnonzero(kinds[mine][:8] != 1)
            lead = int(spoken[0]) if len(spoken) else -1
            if lead < 0 and len(kinds[mine]) > 8:
                out.append(self._decode_slowly(ids[mine]))
                continue
            strip = lead >= 0 and kinds[first[i] + lead] == 0 and part[:1] == b" "
            out.append(part[1:] if strip else part)
        return out

    def _decode_slowly(self, ids: np.ndarray) -> bytes:
        out, held, leading = [], b"", True

        def flush() -> None:
            nonlocal held
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        held[at : at + size].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(held[at : at + size]) == size:
                        out.append(held[at : at + size])
                        at += size
                        break
                else:
                    out.append("�".encode())
                    at += 1
            held = b""

        for i in ids.tolist():
            shown = self.shown[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()
            if self.kinds[i] == 2:
                held += shown
                leading = False
                continue
            flush()
            if self.kinds[i] == 1:
                continue
            if leading and self.kinds[i] == 0 and shown.startswith(b" "):
                shown = shown[1:]
            leading = False
            out.append(shown)
        flush()
        return b"".join(out)


def _valid(part: bytes) -> bool:
    try:
        part.decode()
    except UnicodeDecodeError:
        return False
    return True


def _cuts(text: str, newline_alone: bool) -> list[str]:
    """Cut a text (with its leading mark) before each run of marks, and around new lines if no piece holds one."""
    if not text:
        return []
    lines = text.split("\n") if newline_alone else [text]
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        words = line.replace(SPACE, " ").split(" ")
        if k == 0:
            words.insert(0, "")
        # words[0] has no mark before it; an empty word stands between two marks
        if words[0]:
            out.append(words[0])
        if "" not in words[1:]:
            out += [SPACE + w for w in words[1:]]
            continue
        marks = ""
        for w in words[1:]:
            marks += SPACE
            if w:
                out.append(marks + w)
                marks = ""
        if marks:
            out.append(marks)
    return out


_MADE: dict[str, PieceBpe] = {}


def piece_bpe(path: str) -> PieceBpe:
    """The coder of this Python process."""
    if path not in _MADE:
        _MADE[path] = PieceBpe(path)
    return _MADE[path]


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text (null: empty), with begin and end ids.

    Rows pass one by one, so repeated rows give repeated results and an empty table none; a very long text or word is encoded
    whole; other columns, also of the names above, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_bpe(model)
        for batch in pieces(batches, most=4 << 20):
            ids, counts = coder.encode(batch.column(1))
            ends = np.cumsum(counts)
            shas = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            decoded = [hashlib.sha256(t).hexdigest() for t in coder.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(shas), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
