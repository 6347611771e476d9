"""Jump consistent hashing of keys to shards (operator 4)."""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import numbered, rank_in_key, scratch


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key.  Adding a shard moves keys only into the new one."""
    if shards < 1:
        raise ValueError("at least one shard")
    keys = keys.astype(np.uint64)
    out = np.zeros(len(keys), np.int64)
    left, state, at = np.arange(len(keys)), keys.copy(), np.zeros(len(keys), np.int64)
    while len(left):
        out[left] = at
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        going = at < shards
        left, state, at = left[going], state[going], at[going]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a stable key; null keys share one."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document by the law ``key``: doc_id and the shard count alone decide.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (0, 1, ... in each shard, without gaps) and
    grown_shard (with one shard more).  A null text has size 1 and the checksum of an empty one; a null doc_id is a key of
    its own; repeated rows get slots of their own; a very long text is only measured; an empty table gives no rows; other
    columns, also of the names above, are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = numbered(rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)}), "placed")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    ranked = rank_in_key(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", most)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, shards: int = 16, path: str | None = None) -> str:
    """Write whole documents under one folder per shard (shard=0, shard=1, ...); returns the folder.

    A column ``shard`` of ``docs`` gives way to the folder's.
    """
    path = path or scratch(docs.sparkSession, "shards")
    docs.withColumn("shard", shard_of(F.col("doc_id").cast("long"), shards)).write.partitionBy("shard").parquet(path)
    return path
