"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing, each over whole tables.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared
folder that spark.checkpoint.dir names and reads them again for the next, so that a lost executor costs no more than
its stage. All but the last stage return the columns of documents.

In every stage null text is empty text, a null id is an id like others (the smallest), texts of one id are told apart,
very long texts are taken whole, and extra columns of any name stay with their rows. Empty tables give empty results.
Repeated rows stay through the first two stages alike; near-dedup keeps one row of each class of near copies (equal ids:
the least text hash). Without labels or benchmark items nothing is toxic or leaked.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vetstone.llm import op01_toxicity, op03_decontamination, op05_packing, op06_minhash, op07_line_dedup
from vetstone.llm.common import ensure_checkpoint_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return op01_toxicity.without_toxic(docs, op01_toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, or within an edit of one that does, are taken out of the texts."""
    return op07_line_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays, once."""
    return op06_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item has leaked go."""
    return op03_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return op05_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained, similarity and packing stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
