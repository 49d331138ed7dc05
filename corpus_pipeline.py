"""A corpus cleaned, thinned, mixed and encoded: five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from colloquy.llm.common import cut_alone, drop, table
from colloquy.llm.queries import TARGETS, labelled_domains, vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), fit_docs=table(spark, sf_dir, "documents"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8 one document stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mix(docs, labelled_domains(spark, sf_dir), TARGETS, fit_docs=table(spark, sf_dir, "documents"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(docs, vocabulary_path(), with_decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_domains),
    ("BPE encoding and decoding", encode),
]

#: The classifiers are trained, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again. What a stage
    wrote besides, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
