"""A training-data pipeline over ``documents``; every stage is one operator of ``isoreach.llm``.

Each stage is written as Parquet to the folder that all executors share and read again as the next one's input. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoreach.llm import decontamination, jaccard, packing, suffixes, toxicity
from isoreach.llm.registry import table, vocabulary
from isoreach.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those connected by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return jaccard.keep_one(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller doc_id has too are cut out; texts without a rest go."""
    return suffixes.cut_texts(docs, length=50)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages are no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
