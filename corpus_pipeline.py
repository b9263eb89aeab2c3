"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

In every stage a null text counts as empty, an empty table gives an empty
result, repeated rows are treated alike, and extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apportion.llm import common, neardup, packing, secrets, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under the threshold; empty texts and null ids stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id is the smallest of its group of near copies; texts without words stay, rows that repeat a kept doc_id stay together."""
    return neardup.keep_one(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words of passages that occur more than once; of repeated rows both lose them."""
    return substring.strip(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with reported spans masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document's tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", strip_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Learning, hashing and tokenizing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.write_table(docs, name)
    return docs
