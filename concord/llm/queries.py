"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_links, language_id, lexical_search, line_dedup, ngram_lm, packing, piece_bpe, sharding, simhash, sketches, spelling, token_files, toxicity
from ._spark import id_crc

#: File names of the public vocabularies.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, remainder: int) -> Column:
    """The contracts' folds of documents: the crc32 of the id as text."""
    return F.pmod(id_crc(), F.lit(modulus)) == remainder


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE)))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"), _fold(7, 2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _fold(5, 0))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _fold(3, 1))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_neighbours(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_embedding_links, op2_token_files, op3_pieces, op4_jump_shards, op5_ngram_lm, op6_toxicity, op7_language, op8_packing,
    op9_sketches, op10_simhash, op11_line_dedup, op12_spelling, op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op11_line_dedup": line_dedup.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
