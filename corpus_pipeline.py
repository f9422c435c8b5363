"""A corpus pipeline: each stage works on what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import decontaminate, dedup_exact, language_id, near_duplicates, packing
from quillstack.llm.common import shared_folder, table
from quillstack.operators.lineage import remove


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a learned language is recognised."""
    return language_id.drop_unknown(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the last document (by id) of equal texts."""
    return dedup_exact.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the n-gram Jaccard join."""
    return near_duplicates.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every kept document's tokens in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", remove_copies), ("ngram_jaccard_join", remove_near_copies), ("benchmark_decontamination", remove_benchmark), ("best_fit_packing", pack_sequences)]

#: SQL can express neither the learned languages nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each but the last is written as Parquet in the shared folder and read again.

    A stage's folder is removed once its successor's is written; the packing is cut from the last one, which then goes too.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    packed.write.parquet(f"{folder}/packed")
    remove(spark, before)
    return spark.read.parquet(f"{folder}/packed")
