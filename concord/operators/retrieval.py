"""Lexical and vector retrieval, rank fusion and diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, is_blank, tokens
from ..functions.vectors import l2_normalize
from .ordering import shuffled, written

#: Scores of vectors that a task holds at once, 8 bytes each and once more while it cuts them.
SCORES = 4_000_000
#: Postings of a block of documents, or terms of a block of queries, on average: about 60 bytes each while a task adds them up.
POSTINGS = 4_000_000
#: Distinct terms of all queries that are collected as a list at most.
FEW_TERMS = 100_000


def chunk_items(items: DataFrame, size: int = 800) -> DataFrame:
    """Items (item_id, text, ...) in slices of ``size`` characters; a longer item's slices are named ``#chunkN`` from 1."""
    cut = items.select("*", F.posexplode(chunks("text", size)).alias("_n", "_piece"))
    many = F.length("text") > size
    return cut.withColumn("item_id", F.when(many, F.concat(F.col("item_id").cast("string"), F.lit("#chunk"), (F.col("_n") + 1).cast("string"))).otherwise(F.col("item_id").cast("string"))).withColumn("text", F.col("_piece")).drop("_piece", "_n")


def term_counts(items: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, term, tf) of every item."""
    return items.select(F.col(id_column).alias("id"), F.explode(tokens(text)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _postings(corpus: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, n, rows, total, terms, tf) of documents (doc_id, n, rows, total, hashes): their distinct terms, or those ``wanted``, with
    their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = part.column(4)
                h, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                if wanted is not None:
                    asked = np.isin(h, wanted)
                    h, owner = h[asked], owner[asked]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
                ends = pa.array(np.searchsorted(owner[first], np.arange(len(part) + 1)), pa.int32())
                tf = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(ends, pa.array(h[first], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=["doc_id", "n", "rows", "total", "terms", "tf"])

    return corpus.mapInArrow(count, f"doc_id {dict(corpus.dtypes)['doc_id']}, n int, rows bigint, total bigint, terms array<bigint>, tf array<int>")


def bm25_top(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, k: int, k1: float = 1.5, b: float = 0.75, query_block: int = 16384, corpus_block: int = 32768, postings_block: int = POSTINGS, scores_held: int = SCORES) -> DataFrame:
    """The k best documents of each query that share a term with it, ranked from 1 (scores rounded to 6 places, ties by
    ``doc_id``); a query's repeated terms count once, and rows that repeat an id are one document.

    The corpus is tokenised once, to a written row of each document with its terms (as 64 bits of their hash: of T terms about
    T * T / 2^65 pairs share a number) and their occurrences.  Queries and documents are dealt to blocks bounded by their rows and
    by their terms, so that long texts make more blocks and no larger ones, and large enough that each side is dealt a few
    times only; each pair of blocks meets in one task, adds up its scores in a matrix, some queries at a time, and passes on only a
    query's k best, so that common terms never spread to pairs of queries and documents in a shuffle.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[doc_id]
    hashes = lambda t: F.transform(t, lambda x: F.xxhash64(x))
    # read several times below
    asked = written(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(hashes(tokens("text")))).alias("term")), "asked")
    # few terms are a short list, by which most of a document's are dropped where it is read
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    wanted = np.array(few, np.int64) if len(few) <= FEW_TERMS else None
    rows = corpus.select(F.col(doc_id).alias("doc_id"), hashes(tokens("text")).alias("hashes"))
    rows = rows.select("doc_id", F.size("hashes").alias("n"), F.lit(1).cast("long").alias("rows"), F.size("hashes").cast("long").alias("total"), "hashes")
    if not corpus.groupBy(doc_id).count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.min("n").alias("n"), F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.flatten(F.collect_list("hashes")).alias("hashes"))
    found = written(_postings(rows, wanted), "postings")
    stats = found.agg(F.sum("rows").alias("docs"), F.sum("total").alias("tokens"), F.sum(F.size("terms")).alias("postings")).first()
    n_asked = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    docs, n_postings = stats["docs"] or 0, stats["postings"] or 0
    mean_n = (stats["tokens"] or 0) / (docs or 1) or 1.0
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(shuffled(df), "term").groupBy("query_id").agg(F.collect_set(F.struct("term", "df")).alias("terms"))
    n_q = max(1, -(-n_asked["queries"] // query_block), -(-n_asked["terms"] // postings_block))
    n_c = max(1, -(-docs // corpus_block), -(-n_postings // postings_block))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": left["query_id"].slice(0, 0), "doc_id": right["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        asked, terms, tf = (c.combine_chunks() for c in (left["terms"], right["terms"], right["tf"]))
        owner = np.repeat(np.arange(len(left)), np.diff(asked.offsets.to_numpy()))
        column = np.repeat(np.arange(len(right), dtype=np.int32), np.diff(terms.offsets.to_numpy()))
        mine, theirs = asked.flatten(), terms.flatten().to_numpy()
        order = np.argsort(theirs, kind="stable")
        theirs, column, tf = theirs[order], column[order], tf.flatten().to_numpy()[order].astype(float)
        value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * right["n"].to_numpy()[column] / mean_n))
        each, place = np.unique(mine.field("term").to_numpy(), return_inverse=True)
        at, to = np.searchsorted(theirs, each)[place], np.searchsorted(theirs, each, "right")[place]
        df = mine.field("df").to_numpy()
        idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
        met = np.flatnonzero(to > at)
        parts, n = [empty], len(right)
        step, cut = max(1, scores_held // n), max(0, n - k)
        for first in range(0, len(left), step):
            scores = np.zeros((min(step, len(left) - first), n))
            begin, end = np.searchsorted(owner[met], (first, first + step))
            for i in met[begin:end].tolist():  # a term's postings name each document once
                scores[owner[i] - first, column[at[i] : to[i]]] += idf[i] * value[at[i] : to[i]]
            np.round(scores, 6, out=scores)
            least = np.partition(scores, cut, axis=1)[:, cut]
            i, j = np.nonzero((scores >= least[:, None]) & (scores > 0))
            parts.append(pa.table({"query_id": left["query_id"].take(pa.array(i + first)), "doc_id": right["doc_id"].take(pa.array(j)), "score": pa.array(scores[i, j])}))
        return pa.concat_tables(parts)

    theirs = found.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf")
    pairs = _dealt(weighed, "query_id", "qb", n_q, "cb", n_c).groupBy("qb", "cb").cogroup(_dealt(theirs, "doc_id", "cb", n_c, "qb", n_q).groupBy("qb", "cb"))
    return top_k(pairs.applyInArrow(add_up, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), k)


def _dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
    """Rows in one of ``n`` blocks by ``key``, once for each of the ``m`` blocks of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def top_k(scored: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each key, ranked from 1; ties by ``tie``.  Spark cuts each task's rows before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def cosine_scores(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, vector: str, on: str, floor: float, query_block: int = 2048, corpus_block: int = 8192, scores_held: int = SCORES // 4) -> DataFrame:
    """(query_id, doc_id, score): cosine of a stated query set against the rows of equal key ``on`` and vectors of equal length, where the
    rounded score is ``floor`` or more.

    Both sides of a key are dealt to blocks of bounded size; each pair of blocks meets in one task as matrix products, and what
    comes near the floor is summed again component by component.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[doc_id]
    whole = lambda df: df.where(F.col(on).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False)))
    q = whole(queries).select(F.col(query_id).alias("query_id"), l2_normalize(vector).alias("v"), F.col(on).alias("_key"))
    c = whole(corpus).select(F.col(doc_id).alias("doc_id"), l2_normalize(vector).alias("v"), F.col(on).alias("_key"))
    blocks = lambda df, size, name: df.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = written(blocks(q, query_block, "n_q").join(blocks(c, corpus_block, "n_c"), "_key"), "sizes")
    part = lambda df, key, own, n, other, m: df.join(sizes, "_key").withColumn(own, F.pmod(F.xxhash64(key), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("n_q", "n_c")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, rows = [], _by_length(right["v"], False) if len(right) else {}
        for n, (at, block) in (_by_length(left["v"], False) if len(left) else {}).items():
            if n not in rows:
                continue
            there, other = rows[n]
            step = max(1, scores_held // len(other))
            for a in range(0, len(block), step):
                i, j = np.nonzero(~(block[a : a + step] @ other.T < floor - 1e-6))
                score = np.zeros(len(i))
                for d in range(n):
                    score += block[a + i, d] * other[j, d]
                parts.append(pa.table({"query_id": left["query_id"].take(pa.array(at[a + i])), "doc_id": right["doc_id"].take(pa.array(there[j])), "score": pa.array(score)}))
        return pa.concat_tables(parts) if parts else pa.table({"query_id": left["query_id"].slice(0, 0), "doc_id": right["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})

    keys = ["_key", "qb", "cb"]
    pairs = part(q, "query_id", "qb", "n_q", "cb", "n_c").groupBy(*keys).cogroup(part(c, "doc_id", "cb", "n_c", "qb", "n_q").groupBy(*keys))
    found = pairs.applyInArrow(near, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return found.withColumn("score", F.round("score", 6)).where(F.col("score") >= floor)


def _sound(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _by_length(column: pa.ChunkedArray, scaled: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of the vectors of each length, ``scaled`` to unit length."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    out = {}
    for n in np.unique(np.diff(ends)).tolist():
        rows = np.flatnonzero(np.diff(ends) == n)
        vectors = values[ends[rows][:, None] + np.arange(n)[None, :]]
        out[n] = rows, _unit_rows(vectors) if scaled else vectors
    return out


def _nearly_best(scores: np.ndarray, k: int, slack: float, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that may be among the k best of their row, if each may be wrong by half of ``slack``: the k-th best
    of the greatest of each ``width`` columns is no better than the k-th best of all."""
    n = scores.shape[1]
    if n <= k * width:
        cut = max(0, n - k)
        return np.nonzero(scores >= np.partition(scores, cut, axis=1)[:, cut, None] - np.float32(slack))
    tops = np.maximum.reduceat(scores, np.arange(0, n, width), axis=1)
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - np.float32(slack)
    row, group = np.nonzero(tops >= least[:, None])
    column = group[:, None] * width + np.arange(width)
    at, place = np.nonzero((scores[row[:, None], np.minimum(column, n - 1)] >= least[row, None]) & (column < n))
    return row[at], column[at, place]


def cosine_top(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, vector: str, k: int, query_block: int = 8192, corpus_block: int = 32768, scores_held: int = SCORES) -> DataFrame:
    """The k rows of ``corpus`` nearest to each query, ranked from 1 (scores rounded to 6 places, ties by ``doc_id``).

    Queries and corpus are dealt to blocks of bounded size; each pair of blocks meets in one task as matrix products in single
    precision, sums what comes near a query's k best again in double, and passes on those k, so no side is collected or broadcast.  Vectors that are null or
    hold a null or a component that is not finite are left out; only vectors of equal length are compared.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[doc_id]
    q = queries.where(_sound(vector)).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    c = corpus.where(_sound(vector)).select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("v"))
    n_q, n_c = max(1, -(-q.count() // query_block)), max(1, -(-c.count() // corpus_block))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        # in the order that decides ties
        right = right.take(pc.sort_indices(right["doc_id"], null_placement="at_start"))
        parts, rows = [], _by_length(right["v"]) if len(right) else {}
        for n, (at, block) in (_by_length(left["v"]) if len(left) else {}).items():
            if n not in rows:
                continue
            there, other = rows[n]
            rough, slack = other.astype(np.float32), (n + 4) * 2.0**-22 + 1e-6
            step = max(1, scores_held // len(other))
            for a in range(0, len(block), step):
                own = block[a : a + step]
                i, j = _nearly_best(own.astype(np.float32) @ rough.T, k, slack)
                score = np.zeros(len(i))
                for d in range(n):
                    score += own[i, d] * other[j, d]
                np.round(score, 6, out=score)
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                parts.append(pa.table({"query_id": left["query_id"].take(pa.array(at[a + i[best]])), "doc_id": right["doc_id"].take(pa.array(there[j[best]])), "score": pa.array(score[best])}))
        return pa.concat_tables(parts) if parts else pa.table({"query_id": left["query_id"].slice(0, 0), "doc_id": right["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})

    pairs = _dealt(q, "query_id", "qb", n_q, "cb", n_c).groupBy("qb", "cb").cogroup(_dealt(c, "doc_id", "cb", n_c, "qb", n_q).groupBy("qb", "cb"))
    return top_k(pairs.applyInArrow(near, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), k)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def rrf(ranked: DataFrame, k: int = 60, key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of rows (key, doc, ranker, rank from 1, weight): score is the sum of weight / (k + rank).

    Order: score, then first insertion (the earlier ranker's list first, then its rank).
    """
    fused = ranked.groupBy(key, doc).agg(F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("ranker", "rank")).alias("_first"))
    window = Window.partitionBy(key).orderBy(F.desc("score"), "_first", doc)
    return fused.withColumn("rank", F.row_number().over(window)).drop("_first")


def _mmr_order(relevance: np.ndarray, vectors: np.ndarray, docs: list, top: int, trade: float, cap: int) -> list[int]:
    span = relevance.max() - relevance.min()
    scaled = (relevance - relevance.min()) / span if span > 0 else np.ones(len(relevance))
    close = np.full(len(relevance), 0.0)
    free, chosen, used = np.ones(len(relevance), bool), [], {}
    while free.any() and len(chosen) < top:
        value = np.where(free, trade * scaled - (1 - trade) * (close if chosen else 0.0), -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        free[best] = False
        used[docs[best]] = used.get(docs[best], 0) + 1
        if cap and used[docs[best]] >= cap:
            free &= np.array([d != docs[best] for d in docs])
        similar = vectors @ vectors[best]
        close = similar if len(chosen) == 1 else np.maximum(close, similar)
    return chosen


def mmr(pool: DataFrame, top: int = 10, trade: float = 0.5, per_doc_cap: int = 4) -> DataFrame:
    """Greedy diversification per query of rows (query_id, item_id, doc_id, score, rank, vector).

    Each pick maximises trade * relevance (scaled to 0..1 in the pool) - (1 - trade) * greatest cosine to earlier picks; ties
    go to the earlier rank; a document gives at most ``per_doc_cap`` picks (0: any number).  The pool of a query is bounded
    by its rankers' cut.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, float) for v in rows["vector"]])
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        order = _mmr_order(rows["score"].to_numpy(float), vectors, rows["doc_id"].tolist(), top, trade, per_doc_cap)
        picked = rows.loc[order, ["query_id", "item_id", "doc_id", "score"]].copy()
        picked["rank"] = np.arange(1, len(picked) + 1)
        return picked

    kinds = dict(pool.dtypes)
    return pool.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score double, rank int")


def with_hash_vectors(items: DataFrame, text: str = "text", name: str = "vector", dims: int = 64) -> DataFrame:
    """``items`` with a deterministic offline embedding: signed feature hashing of tokens, normalised.

    Tokens are hashed in the JVM and their bins counted in Arrow batches; a model's embedding would stand in the same place.
    """
    hashed = items.withColumn("_hashes", F.transform(tokens(text), lambda t: F.xxhash64(t)))
    fields = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + f", `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            h = lists.flatten().to_numpy()
            sums = np.bincount(owner * dims + h % dims, weights=np.where((h >> 32) & 1, -1.0, 1.0), minlength=batch.num_rows * dims).reshape(-1, dims)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], name])

    return hashed.mapInArrow(run, fields)


def hybrid(queries: DataFrame, items: DataFrame, recall: int = 30, top: int = 10, trade: float = 0.5, per_doc_cap: int = 4) -> DataFrame:
    """Hybrid retrieval of items (item_id, doc_id, text, vector) for queries (query_id, text, vector): BM25 and cosine
    recall, rank fusion, diversification; scores are fused scores rounded to 6 places."""
    # read by both rankers and by the pool; their vectors are made once
    items = written(items.where(~is_blank("text")).select("item_id", "doc_id", "text", "vector"), "items")
    lexical = bm25_top(queries, items, "query_id", "item_id", recall)
    dense = cosine_top(queries, items, "query_id", "item_id", "vector", recall)
    ranked = dense.select("query_id", "doc_id", F.lit(0).alias("ranker"), "rank", F.lit(1.0).alias("weight")).unionByName(lexical.select("query_id", "doc_id", F.lit(1).alias("ranker"), "rank", F.lit(1.0).alias("weight")))
    pool = rrf(ranked).withColumnRenamed("doc_id", "item_id").join(items.select("item_id", "doc_id", "vector"), "item_id")
    return mmr(pool, top, trade, per_doc_cap).withColumn("score", F.round("score", 6))


def dense_only(queries: DataFrame, items: DataFrame, floor: float = 0.0, recall: int = 30, top: int = 10, trade: float = 0.5, per_doc_cap: int = 4) -> DataFrame:
    """Retrieval by vectors alone: the ``recall`` nearest items at ``floor`` or above, diversified."""
    near = cosine_top(queries, items.where(~is_blank("text")), "query_id", "item_id", "vector", recall).where(F.col("score") >= floor)
    pool = near.withColumnRenamed("doc_id", "item_id").join(items.select("item_id", "doc_id", "vector"), "item_id")
    return mmr(pool, top, trade, per_doc_cap).withColumn("score", F.round("score", 6))


def ranked_with_cuts(scored: DataFrame, k: int, floor: float, review: float, extra: int = 5) -> DataFrame:
    """The k + extra best rows of each query (or rows ranked already) with why a row was cut: below ``floor`` (first), or beyond rank k; kept rows under
    ``review`` need a look."""
    rows = scored if "rank" in scored.columns else top_k(scored, k + extra)
    cut = F.when(F.col("score") < floor, "min_score").when(F.col("rank") > k, "top_k").otherwise("")
    return rows.withColumn("cut_by", cut).withColumn("kept", F.col("cut_by") == "").withColumn("needs_review", (F.col("cut_by") == "") & (F.col("score") < review))
