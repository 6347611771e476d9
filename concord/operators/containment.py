"""Which texts contain which names: every occurrence of any of many names in one pass over each text.

Names become one Aho-Corasick automaton of bounded size; tasks run it over Arrow batches of texts, so the work grows with the
texts and with what is found, not with names times texts.  More names than one automaton may hold are taken in turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .ordering import number_rows, written

#: Characters of the names of one automaton; about 60 bytes of a task's memory each.
AUTOMATON_CHARS = 2_000_000


def _turns(names: DataFrame, most: int) -> list[list[str]]:
    """The distinct names, in lists of about ``most`` characters: by ranges of their order, so no list depends on another's."""
    total = names.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0
    if total <= most:
        found = [[r["name"] for r in names.collect()]]
        return [x for x in found if x]
    placed = written(number_rows(names.withColumn("size", F.length("name")), ["name"], "no"), "names")
    turns, per = [], max(1, int(placed.count() * most / total / 2))
    for start in range(0, placed.count(), per):
        turns.append([r["name"] for r in placed.where((F.col("no") > start) & (F.col("no") <= start + per)).collect()])
    return turns


def contained(texts: DataFrame, text: Column, keys: list[str], names: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """(keys..., name): the distinct ``names`` (name; null and empty ones are nobody's) that each row's ``text`` holds as a substring.

    Equal rows give equal rows; a null text holds nothing.  Texts are read whole.
    """
    rows = texts.select(*keys, text.alias("_text"))
    schema = StructType([*(rows.schema[k] for k in keys), StructField("name", StringType())])
    wanted = written(names.select("name").where("name <> ''").distinct(), "names")
    out = rows.sparkSession.createDataFrame([], schema)
    for turn in _turns(wanted, most):

        def run(batches: Iterator[pa.RecordBatch], turn: list[str] = turn) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, name in enumerate(turn):
                automaton.add_word(name, k)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                    hits = {k for _, k in automaton.iter(value)} if value else ()
                    at.extend([i] * len(hits))
                    found.extend(hits)
                if at:
                    held = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*held.columns[: len(keys)], pa.array([turn[k] for k in found], pa.string())], names=[*keys, "name"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out
