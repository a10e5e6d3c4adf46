"""The corpus pipeline: five stages over the documents table, each a thin use of one operator.

A stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a
DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder and reads them again, so
a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import drop_path, shared_path, table
from corpusmill.llm.exact_dedup import drop_exact_copies
from corpusmill.llm.mixing import take_mix
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.quality import keep_good
from corpusmill.llm.simhash import MAX_BITS, keep_one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays.

    Links are SimHash fingerprints of at most two different bits, found by the range join over their
    embedding as in op6, and shingle sets of a similarity of 0.8 or more.
    """
    return keep_one_of_each(docs, max_bits=MAX_BITS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return take_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", source_mix),
    ("best-fit packing", packed_sequences),
]

#: The classifier's, the fingerprints' and the tokenizer's work is none that SQL can express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            drop_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
