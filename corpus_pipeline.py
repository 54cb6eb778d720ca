"""From raw documents to token ids: the corpus operators as stages over one table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bag_minhash import drop_near_duplicates
from tidemark.llm.exact_dedup import drop_duplicates
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.pieces import Vocabulary, encode
from tidemark.llm.quality import keep_good
from tidemark.session import cut_lineage

PIECES = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7 stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    return drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents leave as often as the mix draws them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids and round_trip of every document of the mix."""
    return encode(docs, Vocabulary(PIECES))


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("sentencepiece", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on the rows that its predecessor kept, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
