"""The corpus pipeline: stages of training-data operators over `documents`.

Every stage but the last returns the columns it is given with their values, whatever their names and types: rows are
carried whole, and Python sees texts and, in packing, ids as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from marketlake.llm.common import ensure_checkpoint_dir, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on `labels`, rejects go.

    A null text counts as empty; texts without words score the share of toxic labels. Rows are judged one by one, so
    repeated rows and null ids have the same fate as their text; an empty table stays empty; without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space apart, one stays: that of the least id, null ids last, one of rows that repeat it; a null text equals the empty one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word n-grams at 0.8 the least id stays; rows without id or words stay."""
    return ngram_join.keep_one_of_each_group(docs, threshold=0.8, n=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a null source is one, documents without words stay once.

    Repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a document's first of several lines is its prompt, which bears no loss."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each but the last is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
