"""Word-level BPE ids of Arrow text batches with the tokenizers library.

The vocabulary's rules never look across ASCII white space, nor across the edge between a letter or digit and the
punctuation that closes a word.  So each distinct word of a batch is cut there and encoded once, and the ids of whole texts
are gathered from the words; a bounded per-process cache keeps words between batches.  Cuts of plain Latin letters need no
normalisation but lower case, so they go straight to the library's BPE model; all others take its whole pipeline.
Words that can hold an added token, such as ``<|endoftext|>``, go through the whole pipeline uncut.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa

from ._words import runs, split_words

#: Distinct words and cuts that a Python worker keeps; a cache starts anew beyond it.
CACHE_WORDS = 500_000
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_CLOSED = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ]")


class WordBpe:
    """Encoder of whole texts with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.width, self.code = ("<u2", "H") if small else ("<u4", "I")
        self.words: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {"": b""}
        latin = [c for c in map(chr, range(0xDF, 0x100)) if _LETTERS.fullmatch(c)]
        # the library looks for added tokens before it cuts, so a word that can hold one is not cut
        self.marks = {frozenset(t.content) & frozenset(string.punctuation) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytelevel = {ord(c): "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in latin}

    def _learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        if len(self.words) + len(words) > CACHE_WORDS:  # then ``words`` are all that the batch needs
            self.words.clear()
            self.cuts.clear()
            self.cuts[""] = b""
        stems = [w.rstrip(string.punctuation) for w in words]
        stems = [s if not s or len(s) == len(w) or _CLOSED.match(s[-1]) else w for s, w in zip(stems, words, strict=True)]
        stems = [w if len(s) < len(w) and any(map(set(w).issuperset, self.marks)) else s for s, w in zip(stems, words, strict=True)]
        tails = [w[len(s) :] for s, w in zip(stems, words, strict=True)]
        cuts, model = self.cuts, self.model
        new = {c for c in stems if c not in cuts} | {c for c in tails if c not in cuts}
        plain = [c for c in new if _LETTERS.fullmatch(c) and all(self.marks)]
        spelled = [c.lower() if c.isascii() else c.lower().translate(self.bytelevel) for c in plain]
        code = self.code
        cuts.update(zip(plain, [array(code, [t.id for t in model.tokenize(c)]).tobytes() for c in spelled], strict=True))
        rest = [c for c in new if c not in cuts]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        cuts.update(zip(rest, [array(code, f.ids).tobytes() for f in found], strict=True))
        self.words.update(zip(words, [cuts[s] + cuts[t] for s, t in zip(stems, tails, strict=True)], strict=True))

    def encode(self, text: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); ``end`` is appended to each text."""
        doc, distinct, index = split_words(text, lower=False)
        listed = distinct.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in listed if w not in self.words]
        if missing:
            if len(self.words) + len(missing) > CACHE_WORDS:
                missing = listed
            self._learn(missing)
        known = self.words
        coded = [known[w] for w in listed]
        step = np.dtype(self.width).itemsize
        sizes = np.fromiter(map(len, coded), np.int32, len(coded)) // step
        values = np.frombuffer(b"".join(coded), self.width)
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        counts = np.bincount(doc, weights=each, minlength=len(text)).astype(np.int64)
        ids = values[runs(starts[index], each)]
        if end is None:
            return ids, counts
        out = np.full(len(ids) + len(text), end, self.width)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1


_MADE: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of this Python process."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]
