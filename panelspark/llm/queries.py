"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import collocations, deobfuscate, hilbert, line_spread, mixing, multiset_hash, nbsvm, nn_descent, pieces, prefix_trie, simhash, suffix_dedup, url_bloom
from panelspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op5_line_dedup": line_spread.SQL, "op6_url_filters": url_bloom.SQL, "op8_mixing": mixing.SQL, "op11_sharding": hilbert.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_collocations": collocations.SQL}


def piece_model() -> str:
    """The model file; ``PIECE_MODEL`` names another place."""
    if path := os.environ.get("PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


@query
def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.learn(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model).withColumn("held_out", nbsvm.held_out())


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.report(table(spark, sf_dir, "documents"))


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_bloom.judge(pages, url_bloom.spam_list(pages))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), pieces.model_bytes(piece_model()))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.report(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(table(spark, sf_dir, "documents"))
