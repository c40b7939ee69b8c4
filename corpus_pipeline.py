"""The corpus pipeline: five operators in a row over documents, each on all that the one before it kept.

Toxic documents go, then exact copies, then near copies but one of each group, then documents that hold a benchmark
item; what is left is encoded.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from strandloom.llm.common import Scratch, scratch_deleted


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return toxicity.without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_first_copies(spark, docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return simhash.keep_one_of_each(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_items(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encode_decode", encoding_stage),
]

#: A learned model, SimHash and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written before the next reads them.

    A null text counts as empty and a null doc_id as an id of its own that no rule names.  Of rows that repeat a
    document (one doc_id, one text) exact dedup keeps one; the other stages treat repeated rows alike.  An empty
    table gives no rows.  Columns that the stages don't read, whatever their names, are carried to the last one.
    What a stage wrote for itself is deleted once its rows are written, and its rows once the next stage's are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for (name, stage), before in zip(STAGES[:-1], [None, *(n for n, _ in STAGES)], strict=False):
        with scratch_deleted():
            docs = s.write(stage(spark, docs, sf_dir), name)
        if before:
            s.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
