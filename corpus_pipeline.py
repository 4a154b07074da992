"""A training-data pipeline over `documents`: five stages, each one operator.

language ID -> exact dedup -> SimHash near-dedup -> benchmark decontamination -> best-fit packing.
Each stage's result is written as Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm._util import Stash
from tapeworks.llm.decontaminate import keep_clean
from tapeworks.llm.exact_dedup import keep_largest
from tapeworks.llm.langid import keep_identified
from tapeworks.llm.near_copies import keep_distinct
from tapeworks.llm.packing import pack_documents
from tapeworks.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without any letter go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest doc_id of each group of equal texts."""
    return keep_largest(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near copies: five words a shingle, similarity 0.8, verified."""
    return keep_distinct(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", clean),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the language profiles nor the fingerprints' classes; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash, before = Stash(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = stash.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            stash.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
