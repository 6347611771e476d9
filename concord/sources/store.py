"""Published runs: tables of a run become visible all at once, by one rename of a manifest; statistics merge; newest first."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a root whose names begin so are no runs.
RESERVED = ("_", ".")
MANIFEST = "_manifest"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, modified) of what lies in a folder; none if it is not there."""
    fs, at = _fs(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _manifests(spark: SparkSession, root: str, run: str) -> list[str]:
    """Manifests of a run in the order of their publication."""
    return sorted(n for n, _ in _names(spark, f"{root}/{run}") if n.startswith(MANIFEST) and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, run: str) -> dict:
    """What the last publication of a run says; empty if it has none."""
    found = _manifests(spark, root, run)
    if not found:
        return {}
    fs, at = _fs(spark, f"{root}/{run}/{found[-1]}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def merge_stats(old: dict, new: dict) -> dict:
    """Statistics of a run after another step: new values win, keys that only the old ones have stay, nested ones alike."""
    both = {k: merge_stats(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}
    return {**old, **both}


def publish(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], stats: dict | None = None) -> None:
    """Write the tables of a run under names of their own, then show them by renaming one manifest.

    Until the rename readers see the version before; after a crash in between they still do, and the files that nobody names are
    only litter.  Tables of earlier publications that are not among ``tables`` stay, statistics are merged.  A second writer that
    publishes at the same moment fails rather than hide the first.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{run}/_tables/{name}-{version}")
    before = manifest(spark, root, run)
    after = {"tables": {**before.get("tables", {}), **{name: f"_tables/{name}-{version}" for name in tables}}, "stats": merge_stats(before.get("stats", {}), stats or {}), "published": time.time()}
    number = len(_manifests(spark, root, run))
    draft = f"{root}/{run}/_draft-{version}"
    _write_text(spark, draft, json.dumps(after, ensure_ascii=False, allow_nan=False))
    fs, target = _fs(spark, f"{root}/{run}/{MANIFEST}-{number:08d}.json")
    if not fs.rename(_fs(spark, draft)[1], target):
        raise FileExistsError(f"run {run} was published by another writer at the same time")


def read_table(spark: SparkSession, root: str, run: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{run}/{manifest(spark, root, run)['tables'][name]}")


def exists(spark: SparkSession, root: str, run: str, name: str) -> bool:
    return name in manifest(spark, root, run).get("tables", {})


def list_runs(spark: SparkSession, root: str, needed: str | None = None) -> list[str]:
    """Published runs of a root (with a table ``needed``), the last published first; reserved folders and unpublished ones are no runs."""
    found = []
    for name, _ in _names(spark, root):
        shown = {} if name.startswith(RESERVED) else manifest(spark, root, name)
        if shown and (needed is None or needed in shown["tables"]):
            found.append((-shown["published"], name))
    return [name for _, name in sorted(found)]


def save_report(spark: SparkSession, lines: DataFrame, root: str, name: str) -> str:
    """A report (ord, line) as one Markdown file below ``root``; visible when it is whole, a report of that name is replaced.

    Reports are for readers: what their tables hold is the run's to bound.
    """
    name = name if name.endswith(".md") else f"{name}.md"
    text = "\n".join(r["line"] for r in lines.orderBy("ord").select("line").toLocalIterator())
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, text)
    fs, target = _fs(spark, f"{root}/{name}")
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(_fs(spark, draft)[1], target)
    return f"{root}/{name}"


def list_reports(spark: SparkSession, root: str) -> list[str]:
    """Paths of the reports of a root, newest first."""
    return [f"{root}/{n}" for n, _ in sorted((x for x in _names(spark, root) if x[0].lower().endswith(".md")), key=lambda x: (-x[1], x[0]))]


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) of all reports of a root."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
