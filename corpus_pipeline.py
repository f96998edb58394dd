"""The corpus pipeline: ``documents`` to packed training sequences in five stages.

Each stage calls one operator of ``citeweave.llm`` on all that the stage before it kept.
All but the last return the columns of ``documents`` (``n_chars`` follows the text); the
last returns the pieces of the documents and their places in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import language_id, line_dedup, packing, simhash, substring_dedup
from citeweave.session import Workspace


def _count_chars(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in no language that the network knows go."""
    return language_id.in_a_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts."""
    return _count_chars(line_dedup.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_of_each_group(docs, shingle=4, max_distance=4)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of paragraphs that repeat, exactly or nearly, go from the texts."""
    return _count_chars(substring_dedup.substring_dedup(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", packed),
]

#: Trained, iterative and numpy stages: SQL cannot express them (tests/llm has brute force instead).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
