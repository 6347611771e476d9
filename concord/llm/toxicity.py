"""Toxicity by compression distance (operator 6).

Two separate zstandard dictionaries are made of a bounded sample: one of ordinary windows by the zstandard trainer, one of what
toxic texts hold far more often than ordinary ones: beginnings of words, those of the greatest contrast of document
frequencies last, where references are short.  Each window of a text is compressed with either; by how much the toxic
dictionary is shorter, beyond a threshold for the window's length, is evidence, which is summed over the text.  Thresholds, the
threshold of a text and the slope of its score come from a third of the sample that no dictionary has seen.

A window is one word with the spaces around it (a long word gives several), every byte spelled out as two, so that a match
saves in proportion to its length against the few bytes that zstandard spends on any match.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ._sample import beside_rows, kept_rows, sample_by_class, text_hash
from ._words import split_words

#: Distinct whole labelled texts sampled per class to train and calibrate; bytes of the longest that is sampled while a class has others.
SAMPLE_DOCS, SAMPLE_TEXT = 1500, 40_000
#: Bytes of the dictionary of ordinary windows, the trainer's segment and the compression level.
ORDINARY_BYTES, SEGMENT, LEVEL = 16_384, 32, 9
#: Beginnings of words in the toxic dictionary at most, bytes of one (with the space before it), and how many may share the first STEM.
BEGINNINGS, SHORTEST, LONGEST, STEM, ALIKE = 120, 5, 11, 6, 4
#: Standard errors by which a beginning's share of toxic texts must exceed that of ordinary ones, and toxic texts that must hold it.
CONTRAST, HOLDERS = 5.0, 4
#: How the compressor looks for matches.
STRATEGY, SEARCH = zstandard.STRATEGY_BTOPT, 8
#: Share of ordinary windows of one length whose gain stays below the length's threshold; lengths from LENGTHS on are one.
QUIET, LENGTHS = 0.995, 24
#: The evidence of a text is divided by the root of its windows and of so many more.
MORE_WINDOWS = 20
#: Bytes of a window's word; longer words give windows that overlap by half.
WORD = 48
#: Every byte of a window is spelled out as so many bytes, by a fixed random table: letters stay alike, but runs do not arise.
DRAWN = 2
_MARKS = ".,;:!?\"'()"
#: Begins every window and ends the dictionaries: one long match pays what any compressed block costs, so that a further
#: match counts in full.
PRIMER = bytes(range(128, 160))
#: Gains of words that a Python worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 200_000
_TABLE = {k: bytes(row).decode("latin-1") for k, row in enumerate(np.random.default_rng(7).integers(0, 256, (256, DRAWN), np.uint8))}


def spell(plain: bytes) -> bytes:
    return plain.decode("latin-1").translate(_TABLE).encode("latin-1")


def windows(word: str) -> list[bytes]:
    """The windows of a word, in plain bytes."""
    plain = word.strip(_MARKS).encode("utf-8", "surrogatepass")
    if len(plain) <= WORD:
        return [b" " + plain + b" "] if plain else []
    return [b" " + plain[at : at + WORD] + b" " for at in range(0, len(plain) - WORD // 2, WORD // 2)]


def text_windows(text: str) -> list[bytes]:
    """The windows of a text's distinct words."""
    return [w for word in dict.fromkeys(text.lower().split()) for w in windows(word)]


def ordinary_dictionary(texts: list[str]) -> bytes:
    """A dictionary of the zstandard trainer.  Where there is too little text for it, the dictionary is all the windows there are."""
    spelled = [spell(w) for t in texts for w in text_windows(t)]
    random.Random(5).shuffle(spelled)  # the trainer takes parts of its input in turn
    if sum(map(len, spelled)) < 10 * ORDINARY_BYTES:
        return b"".join(dict.fromkeys(spelled))
    return zstandard.train_dictionary(ORDINARY_BYTES, spelled, k=SEGMENT, d=8, f=20, accel=1).as_bytes()


def _beginnings(text: str) -> set[bytes]:
    return {w[:n] for w in text_windows(text) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def toxic_beginnings(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Beginnings of words that toxic texts hold more often, the greatest contrast first."""
    held = Counter(b for t in toxic for b in _beginnings(t))
    often = {b for b, n in held.items() if n >= min(HOLDERS, len(toxic))}
    elsewhere = Counter(b for t in ordinary for b in _beginnings(t) & often)

    def contrast(b: bytes) -> float:
        share, other = held[b] / len(toxic), (elsewhere[b] + 0.5) / (len(ordinary) + 1)
        return (share - other) / (other * (1 - other) * (1 / len(toxic) + 1 / len(ordinary))) ** 0.5

    graded = {b: contrast(b) for b in often}
    out, stems = [], Counter()
    # short beginnings are found in more words by chance
    for b in sorted((b for b, z in graded.items() if z >= CONTRAST), key=lambda b: (-graded[b] * min(1, len(b) / 7), b)):
        if stems[b[:STEM]] < ALIKE:
            stems[b[:STEM]] += 1
            out.append(b)
    return out[:BEGINNINGS]


class Coder:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        kind = zstandard.ZstdCompressionDict(dictionary + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=STRATEGY, window_log=20, hash_log=17, chain_log=17, search_log=SEARCH, min_match=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        kind.precompute_compress(compression_params=parameters)
        self._compress = zstandard.ZstdCompressor(dict_data=kind, compression_params=parameters).compress

    def size(self, spelled: bytes) -> int:
        """Compressed bytes of a window that is spelled out."""
        return len(self._compress(PRIMER + spelled))


class ToxicityModel:
    """Dictionaries, thresholds and calibration; pickles to executors."""

    def __init__(self, ordinary: bytes, toxic: bytes, quiet: dict[int, float], threshold: float = 0.0, slope: float = 1.0) -> None:
        self.ordinary, self.toxic, self.quiet, self.threshold, self.slope = ordinary, toxic, quiet, threshold, slope

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.quiet, self.threshold, self.slope

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _size(self, side: int, spelled: bytes) -> int:
        if not hasattr(self, "_coders"):
            self._coders, self._literal = (Coder(self.ordinary), Coder(self.toxic)), {}
        return self._coders[side].size(spelled)

    def gain(self, window: bytes) -> int:
        """Bytes by which the toxic dictionary is shorter than the ordinary one; negative if it is longer."""
        spelled = spell(window)
        return self._size(0, spelled) - self._size(1, spelled)

    def literal(self, n: int) -> int:
        """Compressed bytes of ``n`` bytes that no dictionary holds: no dictionary makes a window longer."""
        if n not in self._literal:
            self._literal[n] = self._size(1, np.random.default_rng(n).bytes(n))
        return self._literal[n]

    def excess(self, window: bytes) -> float:
        """The gain over the threshold of windows of this length (of the nearest length that has one), 0 below it.

        The gain is no more than what the toxic dictionary saves against bare literals, so few windows need the other dictionary.
        """
        n = min(LENGTHS, len(window))
        limit = self.quiet.get(n)
        if limit is None:
            limit = self.quiet[min(self.quiet, key=lambda x: (abs(x - n), x))] if self.quiet else 0.0
        spelled = spell(window)
        toxic = self._size(1, spelled)
        if self.literal(len(spelled)) - toxic <= limit:
            return 0.0
        return max(0.0, self._size(0, spelled) - toxic - limit)

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """(sum of excesses, number) of each word's windows."""
        if not hasattr(self, "_seen") or len(self._seen) + len(words) > CACHE_WORDS:
            self._seen = {}
        seen = self._seen
        for w in words:
            if w not in seen:
                found = windows(w)
                seen[w] = (sum(map(self.excess, found)), len(found))
        return np.array([seen[w] for w in words], np.float64).reshape(-1, 2)

    def evidence(self, text: pa.Array) -> np.ndarray:
        """The summed excesses of the distinct words of each whole text, by the root of their number; 0 without words."""
        doc, words, index = split_words(pc.utf8_lower(text))
        pairs = np.unique(doc.astype(np.int64) * max(1, len(words)) + index)
        each = self.word_evidence(words.to_pylist())[pairs % max(1, len(words))]
        of = pairs // max(1, len(words))
        total, count = (np.bincount(of, weights=each[:, k], minlength=len(text)) for k in (0, 1))
        return total / np.sqrt(count + MORE_WINDOWS)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.threshold), -50, 50)))


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Make the dictionaries of two thirds of the sample and calibrate on the rest."""
    if not toxic or not ordinary:  # one class alone: its prior decides
        return ToxicityModel(b" " * 8, b" " * 8, {}, -100.0 if toxic else 100.0)
    held = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 == 0
    toxic_train, ordinary_train = ([t for t in texts if not held(t)] or texts for texts in (toxic, ordinary))
    toxic_rest, ordinary_rest = ([t for t in texts if held(t)] or texts for texts in (toxic, ordinary))
    model = ToxicityModel(ordinary_dictionary(ordinary_train), b"".join(map(spell, reversed(toxic_beginnings(toxic_train, ordinary_train)))), {})
    gains: dict[int, list[float]] = defaultdict(list)
    known: dict[bytes, int] = {}
    for text in ordinary_rest:
        for w in text_windows(text):
            if w not in known:
                known[w] = model.gain(w)
            gains[min(LENGTHS, len(w))].append(known[w])
    model.quiet = {n: max(1.0, float(np.quantile(found, QUIET))) for n, found in gains.items()}
    return calibrate(model, *(model.evidence(pa.array(texts, pa.string())) for texts in (toxic_rest, ordinary_rest)))


def calibrate(model: ToxicityModel, toxic: np.ndarray, ordinary: np.ndarray) -> ToxicityModel:
    """The threshold with the least rate of errors, ordinary texts counted twice (of equal ones the highest), and the slope
    around it that makes the labels likeliest."""
    cuts = np.unique(np.concatenate([toxic, ordinary]))
    cuts = np.concatenate([[cuts[0] - 0.5], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 0.5]])
    errors = np.array([(toxic < c).mean() + 2 * (ordinary >= c).mean() for c in cuts])
    model.threshold = float(cuts[np.flatnonzero(errors <= errors.min() + 1e-9)[-1]])
    slopes = 2.0 ** np.arange(-4, 4)
    loss = [np.logaddexp(0, -s * (toxic - model.threshold)).mean() + np.logaddexp(0, s * (ordinary - model.threshold)).mean() for s in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model of a bounded sample of the ``learnable`` documents with a toxic label of 0 or 1.

    A document with several labels counts as toxic if one of them says so.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    eligible = docs.where(learnable & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    eligible = eligible.withColumn("h", text_hash("text"))
    sizes = eligible.select("id", "h", F.octet_length("text").alias("size"))
    found = sample_by_class(sizes.join(marked, "id"), eligible.select("h", "text"), per_class, SAMPLE_TEXT)
    return fit(found.get(1, []), found.get(0, []))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``row`` (all columns of ``docs``) and the score of every whole text."""
    return beside_rows(docs, [StructField("score", DoubleType())], lambda text: [pa.array(model.scores(model.evidence(text)))], 2 << 20)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns labels of rows that are not held out.

    Null and empty texts have no window and score as ordinary; repeated rows score each, equal texts alike; a very long text or
    word is read whole, in linear time; an empty table gives no rows; other columns, also of the names above, are ignored.
    """
    model = learn(docs, labels, ~held_out)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), model)
    return rows.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """The documents that are not classed as toxic, unchanged, whatever the names of their columns; null and empty texts stay."""
    return kept_rows(score(docs, learn(docs, labels, learnable)), F.col("score") < 0.5, docs.columns)
