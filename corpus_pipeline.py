"""From raw documents to packed training sequences, as stages of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm.common import documents, stage_table
from loomlake.llm.jaccard import drop_near_copies
from loomlake.llm.packing import pack_documents
from loomlake.llm.queries import vocabulary
from loomlake.llm.suffix import drop_repeats
from loomlake.llm.toxicity import drop_toxic, train


def short_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: fewer of them go to a worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or of their sentences doesn't call toxic."""
    short_batches(spark)
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the least doc_id."""
    short_batches(spark)
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that earlier documents have."""
    short_batches(spark)
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 tokens."""
    short_batches(spark)
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Shingles, ranks and token ids of whole texts are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
