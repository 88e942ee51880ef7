"""From raw documents to token ids: quality, near duplicates, repeated passages, source weights, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame. It is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encoded
from tidemark.llm.factors import good_documents
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.mixture import mixed_documents
from tidemark.llm.substrings import without_repeats
from tidemark.session import prepare, work_dir
from tidemark.sources.tables import read_table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without an id stay."""
    return one_of_each(docs, unnamed=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those left without words go."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them; what its source's target cuts is cut."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the hashes of the ids and of the text they decode to."""
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("classify_quality", classify_quality),
    ("drop_near_copies", drop_near_copies),
    ("cut_repeats", cut_repeats),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# SQL can express neither the classifier nor the tokens
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
