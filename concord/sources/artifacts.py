"""Artifacts of runs as partitions, notes and labelled lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_artifact(rows: DataFrame, root: str, name: str, run: str, doc: str) -> None:
    """Write one document's rows of an artifact; those of other runs and documents stay, its own are replaced as a whole."""
    marked = rows.withColumns({"run": F.lit(run), "doc": F.lit(doc)})
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "doc").parquet(f"{root}/{name}")


def load_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def run_capabilities(inventory: DataFrame, needed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per run: what its artifacts (run, artifact) allow, as a boolean column for each capability, and the ones that are lacking."""
    per = inventory.groupBy("run").agg(F.collect_set("artifact").alias("_has"))
    able = {c: F.size(F.array_except(F.array(*map(F.lit, names)), F.col("_has"))) == 0 for c, names in needed.items()}
    every = sorted({n for names in needed.values() for n in names})
    lacking = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, every)), F.col("_has"))), ", ")
    return per.withColumns({**able, "lacking": lacking}).drop("_has")


def read_notes(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(name, text): the Markdown files below a folder, each whole or cut after ``limit`` characters with a mark."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    text = F.col("value") if limit is None else F.when(F.length("value") > limit, F.concat(F.substring("value", 1, limit), F.lit("\n…"))).otherwise(F.col("value"))
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), text.alias("text"))


def read_labelled(spark: SparkSession, path: str, schema: str = "row string, target_doc string, target_text string, expected string") -> DataFrame:
    """Labelled rows, one JSON object a line; broken lines come back in ``broken``."""
    rows = spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows


def payload(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as JSON without its nulls."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))
