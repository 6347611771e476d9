"""Line dedup (operator 11): lines that many documents share stay in one document only.

Native: built-in functions alone.  Every line of at least ``KEY_CHARS`` code points becomes a 128-bit hash of its key with its
document and position.  Rows go to equal ranges of the hash, sorted by hash, document (largest first) and position; a range
streams past, and what is not of the first document of a hash that ``FEWEST`` documents hold is dropped.  Hashes so frequent
that they would fill a task are found by a sketch and take another exact way: only their sums meet.  What a document loses
comes back as a run-length bitmap, and the text meets its bitmap only where it is cut.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, text_column

#: Fixed values of the contract: code points of a key that counts, documents that make a line shared, what is stripped.
KEY_CHARS, FEWEST, WHITE = 20, 3, " \t\n\x0b\x0c\r"
#: Rows of a hash range at most, on average.
RANGE_ROWS = 1_000_000
#: Frequent hashes are over 1 / (4 * shuffle partitions) of all rows each, and so at most this many.
MOST_FREQUENT = 50_000
#: Bytes of bitmaps that are broadcast to the texts; more of them are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(WHITE))
    # lower() agrees with the rule where all is ASCII, and is much faster
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, key_chars: int = KEY_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line with a key of at least ``key_chars`` code points."""
    text = text_column(docs)
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= key_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _frequent(rows: DataFrame, partitions: int) -> DataFrame:
    """(h1) of the hashes that may hold more rows than a quarter of a partition: at most ``MOST_FREQUENT``."""
    most = min(4 * partitions, MOST_FREQUENT)
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {most}, {max(1000, 8 * most)})").alias("top"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("n") / most).select(F.col("t.item").alias("h1"))


def _later_streamed(rows: DataFrame, ranges: int, fewest: int) -> DataFrame:
    """The rows to drop, found as each range of hashes streams past in the order of hash, document and position."""
    at = F.least(F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int")
    same = Window.partitionBy("range", "h1", "h2")
    ranked = (
        rows.withColumn("range", at).repartitionById(ranges, "range")
        .withColumn("nth", F.dense_rank().over(same.orderBy(F.col("doc_id").desc_nulls_last())))
        .withColumn("documents", F.max("nth").over(same))
    )
    return ranked.where((F.col("documents") >= fewest) & (F.col("nth") > 1)).select("doc_id", "text_hash", "pos")


def _later_summed(rows: DataFrame, fewest: int) -> DataFrame:
    """The rows to drop of frequent hashes: the largest document and the count of documents meet, not the rows."""
    by_document = rows.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    sums = by_document.groupBy("h1", "h2").agg(F.max("doc_id").alias("stays"), F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= fewest)
    # at most MOST_FREQUENT hashes
    late = rows.join(F.broadcast(sums), ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("stays")))
    return late.select("doc_id", "text_hash", "pos")


def keep_bitmaps(docs: DataFrame, key_chars: int = KEY_CHARS, fewest: int = FEWEST) -> DataFrame:
    """(doc_id, text_hash, n_dropped, runs) of every document that loses a line, written to the shared folder.

    ``runs`` is the document's bitmap, run-length compressed: array of (keep, drop), so many lines kept, then so many dropped;
    lines after the last run stay.  Rows of one doc_id are one document; rows without an id are one, smaller than all others.
    """
    spark = docs.sparkSession
    rows = materialise(line_hashes(docs, key_chars), "line-hashes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = materialise(_frequent(rows, partitions), "frequent-lines")
    rare = rows.join(F.broadcast(frequent), "h1", "left_anti")
    ranges = max(partitions, -(-rows.count() // RANGE_ROWS))
    late = _later_streamed(rare, ranges, fewest).unionByName(_later_summed(rows.join(F.broadcast(frequent), "h1", "left_semi"), fewest)).distinct()
    document = Window.partitionBy("doc_id", "text_hash")
    islands = late.withColumn("island", F.col("pos") - F.row_number().over(document.orderBy("pos"))).groupBy("doc_id", "text_hash", "island").agg(F.min("pos").alias("from"), F.count(F.lit(1)).cast("int").alias("drop"))
    gaps = islands.withColumn("keep", F.col("from") - F.coalesce(F.lag(F.col("from") + F.col("drop")).over(document.orderBy("from")), F.lit(0)))
    ordered = F.sort_array(F.collect_list(F.struct("from", "keep", "drop")))
    runs = F.transform(ordered, lambda r: F.struct(r["keep"].alias("keep"), r["drop"].alias("drop")))
    return materialise(gaps.groupBy("doc_id", "text_hash").agg(F.sum("drop").alias("n_dropped"), runs.alias("runs")), "keep-bitmaps")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_dropped and runs (null where all stays): by broadcast up to ``BROADCAST_BYTES`` of bitmaps, else by a shuffle."""
    size = bitmaps.agg(F.sum(F.lit(40) + 8 * F.size("runs")).alias("bytes")).first()["bytes"] or 0
    kept = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_dropped", "runs").hint("broadcast" if size <= BROADCAST_BYTES else "merge")
    text = text_column(docs)
    return docs.select("doc_id", text.alias("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")


def deduplicate_lines(docs: DataFrame, key_chars: int = KEY_CHARS, fewest: int = FEWEST) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines before, n_dropped and runs (the bitmap; null if all stays) per document.

    A null or empty text is one empty line, which stays.  Rows that repeat a doc_id are one document, so each keeps what that
    document keeps; rows without an id together are the smallest document.  Text of any length works, also one line of it; an
    empty table gives no rows; other columns, also of the names above, are ignored.
    """
    found = _with_bitmaps(docs, keep_bitmaps(docs, key_chars, fewest))
    flags = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.lit(True), r["keep"]), F.array_repeat(F.lit(False), r["drop"]))))
    left = F.array_join(F.zip_with(F.split("text", "\n"), flags, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), "\n")
    return found.select(
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "runs",
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``deduplicate_lines``."""
    found = deduplicate_lines(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB SQL of the contract.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.stays AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
