"""Language identification by cross-parsing entropy (operator 7).

For each language a suffix automaton is built of the running text of a bounded sample of its labelled documents.  A text is
parsed against it: each phrase is the longest match with that text from where the last phrase ended, across words.  A phrase
costs the bits that name a place in the language's text; the language that needs the fewest, so normalised, wins.

Texts are parsed in segments of a fixed number of letters and spaces, all segments of a batch together, so a long text or a
long word takes time in proportion to its length; a segment's end also ends a phrase, alike in all languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from ._sample import beside_rows, kept_rows, sample_by_class, text_hash

#: Distinct whole labelled texts sampled per language; all of each is learnt.
SAMPLE_DOCS = 32
#: Bytes of the longest text that is sampled while a language has others, and characters learnt of a language at most.
SAMPLE_TEXT, SAMPLE_CHARS = 40_000, 400_000
#: Characters of a segment.
SEGMENT = 256
UNKNOWN = "und"
_NO_LETTERS = r"[^\p{L}]+"


def plain(text: pa.Array) -> pa.Array:
    """Lower case, and one space for whatever stands between letters, at the ends too."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), _NO_LETTERS, " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(spaced, " "), "", " ")


class Automaton:
    """The suffix automaton of a text: its edges in one open hash table, about 32 bytes an edge, whatever the alphabet.

    An edge's key is its state and character code; state 1 is the start, characters that the text lacks have code 0.
    """

    def __init__(self, text: str) -> None:
        alphabet = sorted(set(text))
        self.points = np.array([ord(c) for c in alphabet], np.int64)
        self.width = len(alphabet) + 1
        code = {c: k + 1 for k, c in enumerate(alphabet)}
        nexts: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for k in map(code.__getitem__, text):
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(1)
            at = last
            while at and k not in nexts[at]:
                nexts[at][k] = state
                at = link[at]
            if at:
                other = nexts[at][k]
                if length[at] + 1 == length[other]:
                    link[state] = other
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[other]))
                    length.append(length[at] + 1)
                    link.append(link[other])
                    while at and nexts[at].get(k) == other:
                        nexts[at][k] = copy
                        at = link[at]
                    link[other] = link[state] = copy
            last = state
        sizes = np.fromiter(map(len, nexts), np.int64, len(nexts))
        states = np.repeat(np.arange(len(nexts)), sizes)
        keys = states * self.width + np.fromiter((k for edges in nexts for k in edges), np.int64, len(states))
        self._store(keys, np.fromiter((s for edges in nexts for s in edges.values()), np.int32, len(keys)))
        self.first = np.zeros(self.width, np.int32)
        for k, s in nexts[1].items():
            self.first[k] = s
        self.cost = float(np.log2(max(2, len(text))))

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probing at a load of a quarter to a half; all keys that still seek a place probe together."""
        bits = max(4, int(2 * len(keys) - 1).bit_length() if len(keys) else 4)
        self.shift = np.uint64(64 - bits)
        kind = np.int32 if len(keys) == 0 or int(keys.max()) < 1 << 31 else np.int64
        self.keys, self.values = np.full(1 << bits, -1, kind), np.zeros(1 << bits, np.int32)
        mask, at, left = (1 << bits) - 1, self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            held = free[self.keys[at[free]] == keys[free]]
            self.values[at[held]] = values[held]
            left = np.setdiff1d(left, held, assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def following(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next state of each, 0 where there is none."""
        keys = states * self.width + codes
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], 0)
        left = np.flatnonzero((found != keys) & (found != -1))
        mask = len(self.keys) - 1
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Character codes of code points."""
        table = np.zeros(max(int(points.max()) + 1 if len(points) else 0, int(self.points.max()) + 1 if len(self.points) else 1), np.int32)
        table[self.points] = np.arange(1, len(self.points) + 1)
        return table[points]

    def phrases(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases in each segment of code points: all segments step together, one character a step."""
        codes = self.codes(points)
        out = np.zeros(len(starts), np.int32)
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        count = np.zeros(len(order), np.int32)
        state = np.ones(len(order), np.int64)
        fresh = np.ones(len(order), bool)  # no phrase is open
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, "left"))  # segments longer than ``step``
            c = codes[at[:n] + step]
            now = self.following(state[:n], c)
            # a phrase ends before a character that it cannot take; that begins the next one, or is one if the text lacks it
            broken = now == 0
            again = self.first[c]
            count[:n] += (broken & ~fresh[:n]).view(np.int8)
            lost = broken & (again == 0)
            count[:n] += lost.view(np.int8)
            state[:n] = np.where(broken, np.where(lost, 1, again), now)
            fresh[:n] = lost
        out[order] = count + ~fresh
        return out


class LanguageModel:
    """Automata of samples by language; built once, on the driver, and sent to tasks as tables."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        texts = [" " + "".join(t.lstrip(" ") for t in plain(pa.array(samples[name], pa.string())).to_pylist()) for name in self.languages]
        self.automata = [Automaton(t[:SAMPLE_CHARS]) for t in texts]

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text, ties to the first name: the share of the best language if each bit of cost halves its
        weight."""
        ready = plain(text)
        sizes = pc.utf8_length(ready).to_numpy(zero_copy_only=False).astype(np.int64)
        lettered = sizes > 2
        if not self.languages:
            return [UNKNOWN] * len(text), np.zeros(len(text))
        points = np.frombuffer("".join(ready.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        per = np.where(lettered, -(-sizes // SEGMENT), 0)
        doc = np.repeat(np.arange(len(sizes)), per)
        inside = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
        starts = (np.cumsum(sizes) - sizes)[doc] + inside
        lengths = np.minimum(SEGMENT, sizes[doc] - inside)
        each = np.stack([a.phrases(points, starts, lengths) * a.cost for a in self.automata])
        costs = np.stack([np.bincount(doc, weights=cost, minlength=len(sizes)) for cost in each])
        best = costs.argmin(0)
        weights = np.exp2(-np.minimum(1000, costs - costs.min(0)))
        score = np.where(lettered, 1 / weights.sum(0), 0.0)
        return [self.languages[b] if have else UNKNOWN for b, have in zip(best, lettered, strict=True)], score


def learn(docs: DataFrame, learnable: Column, per_language: int = SAMPLE_DOCS) -> LanguageModel:
    """A model of a bounded sample of the ``learnable`` rows with a non-null lang and text.

    The sample has at most ``per_language`` distinct whole texts of each language; it grows with the number of languages, not
    with the rows.
    """
    eligible = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = eligible.select(F.col("lang").alias("label"), F.col("text").cast("string").alias("text")).withColumn("h", text_hash("text"))
    sizes = rows.select("label", "h", F.octet_length("text").alias("size"))
    return LanguageModel(sample_by_class(sizes, rows.select("h", "text"), per_language, SAMPLE_TEXT))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred and score of every whole text."""

    def work(text: pa.Array) -> list[pa.Array]:
        names, scores = model.predict(text)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return beside_rows(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], work, 2 << 20)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from rows that are not held out.

    A text that is null, empty or has no letter is ``und`` with score 0, and so is every text if nothing can be learnt.
    Repeated rows are predicted each, equal texts alike; ties go to the first language by name; a very long text or word is
    read whole, in linear time; an empty table gives no rows; other columns, also of the names above, are ignored.
    """
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), learn(docs, ~held_out))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, learnable: Column) -> DataFrame:
    """The documents whose language is identified, unchanged, whatever the names of their columns."""
    return kept_rows(predict(docs, learn(docs, learnable)), F.col("lang_pred") != UNKNOWN, docs.columns)
