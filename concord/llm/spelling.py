"""Spelling variant grouping (operator 12).

Words one edit apart are found on a trie that is kept as tables of edges; a node is the prefix that leads to it.  A frontier of
states (word, position, node, edits) is joined with them level by level.  States without an edit are a word's own prefixes.
The first join spends the edit and takes the ``AHEAD`` characters that follow, so that only edits which the trie can go on from
become states; each further join takes the states over one level of ``STRIDE`` characters; those that reach the end of their
word at the end of a word of the trie are neighbours.

An edit lies in the second half of a word or in the first, so states leave their word's own path in its second half only, once on
the trie of the words and once on the trie of the words reversed: no state starts near a root, where all words meet.  Of two
words one code point longer or shorter, the shorter finds the longer; of two of one length, the lesser finds the greater.

Words over ``LONG`` code points, whose prefixes would take the square of their length, are matched by hashes of what stands
before and after each place, in linear space; the pairs so found are compared whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, pieces, shuffled, text_column

#: Fixed values of the contract: the divisor of hashes of runs that lose a code point, code points and occurrences of a word.
TYPO_EVERY, SHORTEST, FEWEST = 97, 5, 3
#: Longest word on the trie.
LONG = 64
#: Characters after the edit that the first join takes, and characters of a further level of the trie.
AHEAD, STRIDE = 3, 16
#: Ends every word on the trie.
END = "."
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Bytes of Latin-1 text that belong to runs, A-Z in lower case; all else is a space.
_RUN = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _document_runs(doc_id: object, text: str) -> Counter:
    """Occurrences of each run of a text (Latin-1 bytes), after the contract's deletions."""
    found = Counter(text.encode("latin-1", "replace").translate(_RUN).split())
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % TYPO_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of all words, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in pieces(batches, "text", 8 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _document_runs(doc_id, text).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > HELD:
                    yield passed()
        if held:
            yield passed()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "word string, n bigint")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest), "words")


def _from(column: str, start: Column | int, length: Column | int | None = None) -> Column:
    """Characters of a column from a position (from 0)."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.length(column) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(F.col(column), start + 1, length)


def _edits(words: DataFrame, half: Column) -> DataFrame:
    """(word, path): the states after the first join.  ``path`` is the word with one edit at ``half`` or after, and the trie has it up to
    ``AHEAD`` characters behind the edit (or another of the same hash, which the levels find out)."""
    size = F.length("word")
    # the word that is searched may be one shorter, and so its half
    shorter = F.greatest(F.floor((size - 1) / 2).cast("int"), F.lit(0))
    ended = words.select("word", F.concat("word", F.lit(END)).alias("path"), half.alias("half"))
    key = lambda start, tail: F.xxhash64(_from("path", 0, start), tail)
    bridges = ended.where(size > 0).select("path", F.explode(F.sequence(shorter, size - 1)).alias("at"))
    at = F.col("at")
    bridges = bridges.select(key(at, _from("path", at + 1, AHEAD)).alias("key"), _from("path", at, 1).alias("char")).distinct()
    own = ended.select("word", "path", F.explode(F.sequence("half", size)).alias("at"))
    inserted = own.select(key(at, _from("path", at, AHEAD)).alias("key"), "word", at.cast("short").alias("at"), F.lit("").alias("old"))
    replaced = own.where(at < size).select(key(at, _from("path", at + 1, AHEAD)).alias("key"), "word", at.cast("short").alias("at"), _from("path", at, 1).alias("old"))
    met = inserted.unionByName(replaced).join(shuffled(bridges), "key").where(F.col("char") > F.col("old"))
    return met.select("word", F.concat(_from("word", 0, at), "char", _from("word", at + F.length("old")), F.lit(END)).alias("path"))


def _along(states: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """The states whose whole path the trie has: one join a level with its edges (parent, label)."""
    ended = words.select(F.concat("word", F.lit(END)).alias("path"))
    for start in range(0, longest + 1, STRIDE):
        edge = lambda: (_from("path", 0, start).alias("parent"), _from("path", start, STRIDE).alias("label"))  # noqa: B023, E731
        edges = ended.where(F.length("path") > start).select(*edge()).distinct()
        # a path that has ended stands still
        over = states.where(F.length("path") <= start) if start else None
        going = (states.where(F.length("path") > start) if start else states).select("word", "path", *edge()).join(shuffled(edges), ["parent", "label"], "left_semi").select("word", "path")
        states = going if over is None else going.unionByName(over)
    return states


def short_neighbours(words: DataFrame, longest: int = LONG) -> DataFrame:
    """(word, near) of all ordered pairs one edit apart; words of at most ``longest`` code points."""
    reached = words.agg(F.max(F.length("word")).alias("n")).first()["n"] or 0
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    near = F.expr(f"substring(path, 1, length(path) - {len(END)})")
    backward = words.select(F.reverse("word").alias("word"))
    forward = _along(_edits(words, half), words, min(reached + 1, longest)).select("word", near.alias("near"))
    mirrored = _along(_edits(backward, size - half), backward, min(reached + 1, longest)).select(F.reverse("word").alias("word"), F.reverse(near).alias("near"))
    found = materialise(forward.unionByName(mirrored).distinct(), "neighbours")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))


_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6


def _around(word: str) -> tuple[list[int], list[int]]:
    """Hashes of all prefixes and of all suffixes of a word, by length of the prefix."""
    before, after = [0], [0]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
    for c in reversed(word):
        after.append((after[-1] * _BASE + ord(c)) % _PRIME)
    after.reverse()
    return before, after


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) of all ordered pairs one edit apart; words of any length, linear in all their code points.

    Two words are one replacement apart if they agree before and after some place; one is the other without a code point if the
    rest around that place is the other cut there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word", 1 << 18):
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before, after = _around(word)
                for start in range(0, len(word) + 1, 100_000):
                    at = range(start, min(start + 100_000, len(word) + 1))
                    gaps = [i for i in at if i < len(word)]
                    columns = [[number] * (len(at) + len(gaps)), [False] * len(at) + [True] * len(gaps), [*at, *gaps], [before[i] for i in at] + [before[i] for i in gaps], [after[i] for i in at] + [after[i + 1] for i in gaps], [len(word)] * len(at) + [len(word) - 1] * len(gaps)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["number", "cut", "at", "before", "after", "rest"])

    numbered = materialise(words.select(F.monotonically_increasing_id().alias("number"), "word"), "long-words")
    keys = materialise(numbered.mapInArrow(run, "number bigint, cut boolean, at bigint, before bigint, after bigint, rest bigint"), "places")
    place = ["at", "before", "after", "rest"]
    cut, whole = keys.where("cut").drop("cut"), keys.where("not cut").drop("cut")
    # words that agree but for the character at one place: no more than the alphabet has
    alike = cut.groupBy(place).agg(F.collect_set("number").alias("all")).where(F.size("all") > 1)
    replaced = alike.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a <> b")
    longer = cut.select(*place, F.col("number").alias("a")).join(shuffled(whole.select(*place, F.col("number").alias("b"))), place).select("a", "b")
    pairs = replaced.unionByName(longer).unionByName(longer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    named = pairs.join(shuffled(numbered.select(F.col("number").alias("a"), "word")), "a").join(shuffled(numbered.select(F.col("number").alias("b"), F.col("word").alias("near"))), "b")
    return named.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def neighbours(words: DataFrame, longest: int = LONG) -> DataFrame:
    """(word, near): all ordered pairs of words that one inserted, deleted or replaced code point parts."""
    short = short_neighbours(words.where(F.length("word") <= longest).select("word"), longest)
    lengthy = words.where(F.length("word") >= longest).select("word")
    return short if lengthy.isEmpty() else short.unionByName(long_neighbours(lengthy)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without loops: pointers double until none moves."""
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.join(shuffled(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    A null text has no word; a null doc_id counts as the empty text in the hash of a run.  Rows that repeat count each, as their
    words occur again; of near words with the same n the smallest in code-point order is the form; text and words of any length
    work; an empty table gives no rows; other columns, also of the names above, are ignored.
    """
    words = word_counts(docs)
    pairs = materialise(neighbours(words), "near")
    described = pairs.join(shuffled(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    # of the largest n, the smallest word
    best = described.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(shuffled(best), "word", "left")
    strong = F.col("best.minus") <= -2 * F.col("n")
    found = materialise(joined.select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    last = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(shuffled(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
