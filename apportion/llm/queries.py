"""The queries of this subpackage: name -> function of a session and a folder of tables."""

from __future__ import annotations

from apportion.llm import fingerprints, neardup, packing, rules, secrets, substring, suffixarray, tokenfile, toxicity, unigram
from apportion.llm.common import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES = {
    "op1_secret_scan": lambda spark, d: secrets.scan(documents(spark, d)),
    "op2_minhash_near_dedup": lambda spark, d: neardup.classes_of(documents(spark, d)),
    "op3_sentencepiece": lambda spark, d: unigram.encode(documents(spark, d)),
    "op4_quality_rules": lambda spark, d: rules.judge(documents(spark, d), labels(spark, d)),
    "op5_suffix_array_dedup": lambda spark, d: suffixarray.dedup(documents(spark, d)),
    "op9_substring_dedup": lambda spark, d: substring.dedup(documents(spark, d)),
    "op6_sequence_packing": lambda spark, d: packing.pack(documents(spark, d)),
    "op10_token_files": lambda spark, d: tokenfile.round_trip(documents(spark, d)),
    "op7_toxicity": lambda spark, d: toxicity.scores(documents(spark, d), labels(spark, d)),
    "op8_document_fingerprint": lambda spark, d: fingerprints.fingerprints(documents(spark, d)),
}
ORACLE_SQL: dict[str, str] = {}
