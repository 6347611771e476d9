"""Small tables around a run: its units of progress, counters of its calls, hints for headers, blocks of background knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import guess_role, is_blank
from .ordering import number_rows

#: Rows of a sheet that are looked at for roles.
HINT_ROWS = 15
# Parts of a document's unit by kind of file.
SHEET_PARTS, BLOCK_PARTS, SHEETS = ("F0 raw", "F1 profile", "F2 schema", "F3 records", "F4a"), ("F0 raw", "F1 profile", "F3 facts", "F4a"), ("xlsx", "xls", "xlsm")


def progress_units(files: DataFrame, with_concepts: bool = True) -> DataFrame:
    """(ord, key, label, kind, parts) of a run over files (pos, path), the first of them the reference: one unit per document, one for the
    concepts, one per comparison; targets of equal name are told apart by ``#2``, ``#3``, ...

    Units are fixed before a run begins and never change in it.
    """
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    known = files.withColumns({"name": name, "parts": F.when(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*SHEETS), F.lit(len(SHEET_PARTS))).otherwise(len(BLOCK_PARTS))})
    docs = known.select(F.lit(0).alias("a"), F.col("pos").alias("b"), F.concat(F.lit("doc:"), F.col("pos").cast("string")).alias("key"), F.col("name").alias("label"), F.lit("doc").alias("kind"), "parts")
    times = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    compared = known.where("pos > 0").withColumn("nth", times).select(F.lit(2).alias("a"), F.col("pos").alias("b"), F.concat(F.lit("compare:"), "name", F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth").cast("string"))).otherwise("")).alias("key"), F.col("name").alias("label"), F.lit("compare").alias("kind"), F.lit(1).alias("parts"))
    out = docs.unionByName(compared)
    if with_concepts:
        out = out.unionByName(files.sparkSession.range(1).select(F.lit(1).alias("a"), F.lit(0).cast(files.schema["pos"].dataType).alias("b"), F.lit("concept").alias("key"), F.lit("concepts").alias("label"), F.lit("concept").alias("kind"), F.lit(1).alias("parts")))
    return out


def runner_stats(calls: DataFrame, key: str) -> DataFrame:
    """(key, calls, retries, parse_failures, structured_calls) of calls (attempt from 1, status, structured)."""
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("attempt") > 1).alias("retries"), F.count_if(F.col("status") == "parse").alias("parse_failures"), F.count_if("structured").alias("structured_calls"))


def worst_case_seconds(timeout: Column, retries: Column, waits: Column, wait: Column) -> Column:
    """Seconds that one call can take when a client retries ``retries`` times inside ``waits`` further rounds after waits of ``wait``
    seconds; null where the two do not multiply."""
    return F.when((wait > 0) & (retries > 0), (retries + 1) * timeout * (waits + 1) + waits * wait)


def role_hints(cells: DataFrame, rows: int = HINT_ROWS) -> DataFrame:
    """(doc, sheet, text, role): distinct texts of a sheet's first ``rows`` full rows (doc, sheet, row, col, value) that name a role."""
    full = cells.where(~is_blank("value"))
    early = full.withColumn("_nth", F.dense_rank().over(Window.partitionBy("doc", "sheet").orderBy("row"))).where(F.col("_nth") <= rows)
    return early.select("doc", "sheet", F.col("value").alias("text")).distinct().withColumn("role", guess_role("text")).where("role is not null")


def knowledge_text(notes: DataFrame, most: int = 12_000, cut: str = "\n…") -> DataFrame:
    """One row (text): all notes (name, text) by name under headers, cut after ``most`` characters with a mark; blank ones left out.

    Only so many notes as the cut can reach are put together.
    """
    titled = notes.where(~is_blank("text")).select("name", F.concat(F.lit("## ["), "name", F.lit("]\n"), F.btrim("text", F.lit(" \t\n\r"))).alias("t"))
    # each note has over four characters, so later ones lie beyond the cut
    near = number_rows(titled, ["name"], "n").where(F.col("n") <= most // 4 + 1).withColumn("t", F.substring("t", 1, most + 1))
    whole = near.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    return whole.select(F.when(F.length("text") > most, F.concat(F.rtrim(F.substring("text", 1, most)), F.lit(cut))).otherwise(F.col("text")).alias("text"))


def knowledge_block(text: Column, head: str, rule: str = "-" * 60) -> Column:
    """Background text between rules under ``head``, for whoever judges; empty for a blank text."""
    return F.when(is_blank(text), "").otherwise(F.concat(F.lit(f"{head}\n{rule}\n"), F.btrim(text, F.lit(" \t\n\r")), F.lit(f"\n{rule}\n")))


def kept_comparisons(rows: DataFrame, target_doc: str | None = None, result: str | None = None, name: str | None = None, slow: float | None = None, errors_only: bool = False) -> DataFrame:
    """Rows that a reader asks for: of a target document, of a result, whose name holds a text whatever its case, that took at least so
    many seconds, or that failed; what is not asked does not matter."""
    if target_doc is not None:
        rows = rows.where(F.col("target_doc") == target_doc)
    if result is not None:
        rows = rows.where(F.col("result") == result)
    if name:
        rows = rows.where(F.contains(F.lower("entity_name"), F.lit(name.lower())))
    if slow is not None:
        rows = rows.where(F.col("seconds") >= slow)
    return rows.where(F.col("status") == "error") if errors_only else rows
