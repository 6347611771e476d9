"""Bounded samples of labelled documents, and rows that keep all their columns beside a new one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._spark import cuts, text_column


def text_hash(text: Column | str) -> Column:
    return F.xxhash64(text, F.lit("sample"))


def sample_by_class(labelled: DataFrame, texts: DataFrame, per_class: int, most: int) -> dict:
    """Whole texts of at most ``per_class`` distinct texts of each non-null ``label``: those of least text hash, among texts of up to
    ``most`` bytes; longer ones serve only a class that has no other, and of those the first ``most`` bytes.

    ``labelled`` is (label, h, size) with the ``text_hash`` and bytes of each labelled text, so that no join or shuffle before carries
    texts; ``texts`` is (h, text).  Of each class only hashes so low that about eight times the sample is left are ranked; then the
    chosen texts reach the driver, once each, in the order of their hashes: no more than classes * per_class * most bytes.
    """
    marked = labelled.where(F.col("label").isNotNull() & F.col("h").isNotNull()).select("label", "h", (F.col("size") > most).alias("long"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    # one row per class
    sizes = marked.groupBy("label").agg(F.approx_count_distinct(F.when(~F.col("long"), F.col("h"))).alias("fit"), F.approx_count_distinct("h").alias("all"))
    own = marked.join(F.broadcast(sizes), "label").where(~F.col("long") | (F.col("fit") == 0)).withColumn("size", F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("all")))
    low = own.where(F.col("h") / 2.0**64 + 0.5 <= 8.0 * per_class / F.col("size"))
    chosen = low.select("label", "h").distinct().withColumn("n", rank).where(F.col("n") <= per_class).select("label", "h").collect()
    out: dict = {label: [] for label in sorted({r["label"] for r in chosen})}
    if chosen:
        wanted = sorted({r["h"] for r in chosen})
        # at most ``most`` characters of the only long texts of a class
        found = {r["h"]: r["text"] for r in texts.where(F.col("h").isin(wanted)).groupBy("h").agg(F.min(F.substring("text", 1, most)).alias("text")).collect()}
        for r in sorted(chosen, key=lambda r: r["h"]):
            out[r["label"]].append(found[r["h"]])
    return out


def beside_rows(docs: DataFrame, new: list[StructField], work: Callable[[pa.Array], list[pa.Array]], most: int) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct, whatever their names) and the ``new`` columns that ``work`` makes of each
    batch of whole texts (null: empty).  A text crosses to Python once, within its row."""
    plain = dict(docs.dtypes)["text"] == "string"
    fields = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*fields).alias("row"), *([] if plain else [text_column(docs).alias("text")]))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            texts = pc.fill_null(whole.field(at), "") if plain else batch.column(1)
            for start, length in cuts(texts, most):
                yield pa.RecordBatch.from_arrays([whole.slice(start, length), *work(texts.slice(start, length))], names=["row", *(f.name for f in new)])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *new]))


def kept_rows(found: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """The rows of ``beside_rows`` that meet the condition, with their own columns."""
    return found.where(condition).select(*(F.col("row").getField(c).alias(c) for c in columns))
