"""From raw documents to packed training sequences, as five Spark stages.

Each stage takes the documents its predecessor kept and returns documents again; run() writes each result as Parquet
into the shared folder and reads it for the next. The last stage returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup as exact
from riskloom.llm import near_dedup as near
from riskloom.llm import packing as sequences
from riskloom.llm import substrings as passages
from riskloom.llm import toxicity as toxic
from riskloom.llm.common import Steps, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of two folds of three."""
    return toxic.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of long passages that stand elsewhere too; n_chars counts what is left."""
    return passages.drop_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2,048 tokens."""
    return sequences.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: Trained models, sketches and tokenizers are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole documents table."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = steps.keep(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            steps.drop(f"stage{number - 1}")
    return docs
