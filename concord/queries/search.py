"""Retrieval: BM25, cosine, rank fusion, diversification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import retrieval as R
from ._tables import TOKENS, Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

BM25_SQL = f"""
    docs as (select doc_id, {TOKENS.format('text')} as terms from documents),
    stats as (select count(*) as n, avg(len(terms)) as mean_n from docs),
    tf as (select term, doc_id, any_value(n) as n, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from docs) group by term, doc_id),
    df as (select term, count(*) as df from tf group by term),
    q as (select distinct item_id as query_id, unnest({TOKENS.format('text')}) as term from benchmark),
    bm25 as (select query_id, doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.n / mean_n))), 6) as score
             from q join tf using (term) join df using (term) cross join stats s group by query_id, doc_id)"""


@add(f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, md5(array_to_string(t, ' ')) as digest from (select doc_id, {TOKENS.format('text')} as t from documents)")
def tokenize_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@add(f"with {BM25_SQL} select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= 3")
def bm25_topk(spark, sf_dir):
    return R.bm25_top(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 3).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_PAIRS = """
    e as (select vec_id, label, embedding::double[] as v from embeddings),
    n as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
    cosine as (select q.vec_id as query_id, c.vec_id as doc_id, round(list_dot_product(q.v, c.v), 6) as score from n q join n c on {on})"""
_COSINE = _PAIRS.format(on="q.vec_id % 20 = 0{on}")


def _nearest(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    return R.cosine_top(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", k)


@add(f"with {_COSINE.format(on='')} select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from cosine) where rank <= 5")
def cosine_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, 5).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@add(f"with {_COSINE.format(on=' and q.label = c.label')} select query_id, doc_id, score from cosine where score >= 0.2")
def cosine_min_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.cosine_scores(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", "label", 0.2)


@add(f"""with {_COSINE.format(on='')}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from cosine)
    select query_id, doc_id, score, rank, case when score < 0.25 then 'min_score' when rank > 3 then 'top_k' else '' end as cut_by, not (score < 0.25 or rank > 3) as kept,
           not (score < 0.25 or rank > 3) and score < 0.5 as needs_review from r where rank <= 8""")
def ranked_cut_by(spark, sf_dir):
    return R.ranked_with_cuts(_nearest(spark, sf_dir, 8), 3, 0.25, 0.5).withColumn("rank", F.col("rank").cast("long"))


@add(f"""with e as (select vec_id as doc_id, text, embedding::double[] as v from embeddings join documents on doc_id = vec_id), v as (select doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
    dense as (select q.doc_id as query_id, c.doc_id, round(list_dot_product(q.v, c.v), 6) as score from v q join v c on q.doc_id % 20 = 0),
    docs as (select doc_id, {TOKENS.format('text')} as terms from e), stats as (select count(*) as n, avg(len(terms)) as mean_n from docs),
    tf as (select term, doc_id, any_value(n) as n, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from docs) group by term, doc_id), df as (select term, count(*) as df from tf group by term),
    q as (select distinct doc_id as query_id, unnest(terms) as term from docs where doc_id % 20 = 0),
    lexical as (select query_id, doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.n / mean_n))), 6) as score from q join tf using (term) join df using (term) cross join stats s group by query_id, doc_id),
    u as (select query_id, doc_id, 0 as ranker, row_number() over (partition by query_id order by score desc, doc_id) as rank from dense qualify rank <= 30
          union all select query_id, doc_id, 1, row_number() over (partition by query_id order by score desc, doc_id) as rank from lexical where score > 0 qualify rank <= 30),
    f as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score, min(ranker * 1000 + rank) as first from u group by query_id, doc_id)
    select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from f""")
def rrf_fusion(spark, sf_dir):
    """Vectors and BM25 of the documents that have a vector, fused."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    # only texts whose ids lie among those of the vectors are dealt for the join
    ids = vectors.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    both = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("doc_id").between(ids["least"], ids["most"])).join(vectors, "doc_id")
    queries = both.where("doc_id % 20 = 0")
    dense = R.cosine_top(queries, both, "doc_id", "doc_id", "embedding", 30)
    lexical = R.bm25_top(queries, both, "doc_id", "doc_id", 30)
    one = F.lit(1.0).alias("weight")
    ranked = dense.select("query_id", "doc_id", F.lit(0).alias("ranker"), "rank", one).unionByName(lexical.select("query_id", "doc_id", F.lit(1).alias("ranker"), "rank", one))
    return R.rrf(ranked).withColumn("rank", F.col("rank").cast("long"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("doc_id"), "text")


@add()
def hybrid_mmr(spark, sf_dir):
    """BM25 and hashed vectors, fused and diversified (greedy, so no SQL)."""
    queries = R.with_hash_vectors(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return R.hybrid(queries, R.with_hash_vectors(_items(spark, sf_dir)))


@add("""select case when length(text) > 800 then doc_id::varchar || '#chunk' || (n + 1) else doc_id::varchar end as item_id, source, length(substring(text, n * 800 + 1, 800)) as n_chars, md5(substring(text, n * 800 + 1, 800)) as digest
    from (select doc_id, source, text, unnest(range(greatest(1, ceil(length(text) / 800.0)::bigint))) as n from documents)""")
def chunk_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", "text")
    return R.chunk_items(d).select("item_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@add(f"""with {_PAIRS.format(on='true')}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from cosine where query_id <> doc_id),
    f as (select r.query_id, min(rank) as rank from r join embeddings a on a.vec_id = r.query_id join embeddings b on b.vec_id = r.doc_id where a.label = b.label and rank <= 10 group by r.query_id),
    q as (select vec_id, label from embeddings)
    select label, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as recall_1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as recall_3, round(avg(rank), 6) as mean_rank, count(*) filter (where rank is null) as undetected
    from q left join f on q.vec_id = f.query_id group by label""")
def recall_at_k(spark, sf_dir):
    """Every vector asks for its nearest among all others."""
    from ..operators.diagnose import recall_at

    vectors = table(spark, sf_dir, "embeddings")
    e = vectors.select("vec_id", "label")
    # blocks of one size on both sides: each side is dealt once for each block of the other
    others = R.cosine_top(vectors, vectors, "vec_id", "vec_id", "embedding", 11, query_block=32768).drop("rank").where("query_id <> doc_id")
    ranked = R.top_k(others, 10)
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("lb"))
    found = ranked.join(a, "query_id").join(b, "doc_id").where("la = lb").groupBy("query_id").agg(F.min("rank").alias("rank"))
    queries = a.withColumnRenamed("la", "label")
    return recall_at(queries.join(found, "query_id", "left"), (1, 3), "label")
