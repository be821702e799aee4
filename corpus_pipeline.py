"""A corpus pipeline: from raw documents to packed sequences of clean, distinct ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyadic.llm.bpe import byte_bpe
from polyadic.llm.exact_dedup import keep_unique
from polyadic.llm.jaccard_join import keep_one_of_similar
from polyadic.llm.packing import pack
from polyadic.llm.quality import keep_good
from polyadic.llm.scratch import small_batches, write_scratch
from polyadic.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id."""
    small_batches(spark)
    return keep_unique(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by five-word shingle similarities of 0.8 or more."""
    small_batches(spark)
    return keep_one_of_similar(docs, n=5, num=8, den=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces, packed into sequences of 2048."""
    import public_tokenizers

    small_batches(spark)
    return pack(docs, byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), end_id=1), size=2048)


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact", exact), ("similar", similar), ("packing", packing)]

#: Trained classifiers and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
