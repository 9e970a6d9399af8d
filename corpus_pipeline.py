"""Corpus pipeline over documents: quality classifier, near-duplicates, benchmark decontamination, personal data, BPE.

Each stage is a function of (spark, docs, sf_dir) and works on what its predecessor kept; all but the last return the
columns of documents.  Nulls, empty texts and repeated rows are treated as each operator's docstring says.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import bpe, decontamination, neardup, pii, quality
from sitewright.llm.common import Scratch
from sitewright.llm.registry import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; n_chars counted anew."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", token_ids),
]

# Fitted models, signatures and merges have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage kept is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.table(str(number), docs)
    return docs
