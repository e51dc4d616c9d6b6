"""Documents to token ids: quality filter, boilerplate lines, near copies, source mix, sentence pieces.

Every stage takes the documents its predecessor kept and returns the columns of documents, the last one the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import line_spread, mixing, nbsvm, pieces, simhash
from panelspark.llm.common import Kept, table
from panelspark.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, scores 0.3 and over."""
    return nbsvm.keep_good(docs, nbsvm.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources show."""
    return line_spread.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken twice stands there twice."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the byte at which each piece ends."""
    return pieces.encode(docs, pieces.model_bytes(piece_model()))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Kept(spark, "pipeline")
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        new, new_path = kept.write(stage(spark, docs, sf_dir))
        if path:
            kept.drop(path)
        docs, path = new, new_path
    return docs
